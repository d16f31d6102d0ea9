"""Text normalisers as Column functions. Columns in, columns out; null counts as empty unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts see it: Unicode's, and the zero-width no-break space.
SPACE = r"(?U)[\s﻿]+"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def clean_punctuated(c: Column) -> Column:
    """clean, without blanks before commas and full stops."""
    return F.regexp_replace(clean(c), r" ([,.])", "$1")


def compact(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]+", "")


def compact_lower(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "")


def label(c: Column) -> Column:
    return F.lower(clean(c))


def squeezed(c: Column) -> Column:
    """Lower case words of ASCII letters and digits, one blank between."""
    return F.lower(F.trim(F.regexp_replace(c, "(?i)[^a-z0-9]+", " ")))


def contains_label(haystack: Column, needle: Column) -> Column:
    """Whether one label stands in another as whole words; an empty one in none."""
    h, n = label(haystack), label(needle)
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")), F.lit(" "))
    return (h != "") & (n != "") & ((h == n) | ((F.trim(words(n)) != "") & F.contains(words(h), words(n))))


# Titles. The five forms differ on purpose: each belongs to a matcher with its own history of accepted links.


def title_link(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(clean(c), "(?i)&amp;", " and "), "(?i)&#(?:189|xbd);", " half "))


def title_catalog(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.replace(F.regexp_replace(clean(c), "(?i)&amp;", " and "), F.lit("&"), F.lit(" and ")), "[’‘`]", "'"))


def title_assisted(c: Column) -> Column:
    return squeezed(F.replace(F.regexp_replace(clean(c), "(?i)&amp;", " and "), F.lit("&"), F.lit(" and ")))


def title_relation(c: Column) -> Column:
    t = F.regexp_replace(F.lower(clean(c)), r"\([^)]*(?:cm|yrs?|years?|mths?|months?|size)[^)]*\)", " ")
    t = F.regexp_replace(t, r"\s+-\s+size\s+.+$", " ")
    return squeezed(F.regexp_replace(t, r"\bsize\s+[a-z0-9\-/(). ]+$", " "))


def title_census(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(text(c), "(?i)&amp;", "and"), "(?i)&#(?:189|xbd);", " half "))


def base_title(c: Column) -> Column:
    """title_catalog without a size or age at its end."""
    t = F.regexp_replace(clean(c), r"(?i)\s*[-–—|]\s*size\s+.+$", "")
    t = F.regexp_replace(t, r"(?i)\s*\(\s*size\s*[:=-]?.+\)\s*$", "")
    ages = r"newborn|tiny baby|premature|preemie|\d+\s*(?:-|to)\s*\d+\s*(?:months?|mths?|years?|yrs?)"
    return title_catalog(F.regexp_replace(t, rf"(?i)\s*[-–—|]\s*(?:size\s*)?(?:{ages}).*$", ""))


PLACEHOLDER_TITLE = r"(?i)^(?:excel import issue|blocked source product|unknown product|product\s+\d+|\[?needs source lookup\]?)"


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def valid_title(c: Column, least_chars: int = 12, least_words: int = 3) -> Column:
    """A title that identifies a product: no placeholder, and long enough without its size."""
    base = base_title(c)
    return (clean(c) != "") & ~clean(c).rlike(PLACEHOLDER_TITLE) & (F.length(base) >= least_chars) & (F.size(words(base)) >= least_words)


#: Words that say nothing about which product is meant.
STOP_WORDS = ("the", "with", "and", "for", "size", "years", "months", "mths")


def tokens(c: Column, least: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of at least `least` characters, without stop words."""
    return F.array_distinct(F.filter(F.split(squeezed(F.regexp_replace(clean(c), "&(?:amp;)?", " and ")), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's; 0 if either is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger set's; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


# Vendors. Names that the matchers take for one vendor.

VENDORS_CATALOG = {
    "NEXT": ("NXT", "NEXT"),
    "HM": ("HM", "HANDM"),
    "MAX": ("MAX", "MAXFASHION"),
    "CENTREPOINT": ("CENTREPOINT", "CENTREPOINTSTORES"),
    "MARKSANDSPENCER": ("MNS", "MS", "MARKSANDSPENCER", "MARKSSPENCER"),
}
VENDORS_RELATION = (
    ("marksandspencer", "marksandspencer(?:me|uae|ae)?"),
    ("centrepoint", "centrepoint(?:stores)?"),
    ("max", "max(?:fashion)?"),
    ("hm", "(?:handm|hm)(?:uae|ae)?"),
    ("mothercare", "mothercare(?:uae|ae)?"),
    ("carters", "carters(?:uae|ae)?"),
    ("adidas", "adidas(?:uae|ae)?"),
    ("next", "next(?:uae|ae|direct)?"),
    ("zara", "zara(?:uae|ae)?"),
    ("lefties", "lefties(?:uae|ae)?"),
)


def vendor_catalog(c: Column) -> Column:
    key = compact(c)
    named = reduce(lambda out, kv: F.when(key.isin(*kv[1]), kv[0]).otherwise(out), VENDORS_CATALOG.items(), key)
    return F.when(key.startswith("CARTER"), "CARTERS").otherwise(named)


def vendor_relation(c: Column) -> Column:
    key = F.regexp_replace(F.replace(F.lower(clean(c)), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")
    rest = F.regexp_replace(key, "(?:uae|official|onlinestore|store)$", "")
    return reduce(lambda out, kv: F.when(key.rlike(f"^{kv[1]}$"), kv[0]).otherwise(out), VENDORS_RELATION, rest)


def vendor_lower(c: Column) -> Column:
    return compact_lower(c)


def sku_token(c: Column, most: int = 24) -> Column:
    """Upper case, other characters as single hyphens, none at the ends, cut to `most`."""
    t = F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]+", "-")
    return F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, most)


def decode_minimal(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), "(?i)&amp;", "&"), "(?i)&#x2F;", "/"), "&#47;", "/")


def visible_text(c: Column) -> Column:
    """What a page shows: no scripts, styles or tags."""
    t = reduce(lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}.*?</{tag}>", " "), ("script", "style", "noscript"), text(c))
    return clean(F.regexp_replace(t, "<[^>]+>", " "))


def html_text(c: Column) -> Column:
    return clean(F.regexp_replace(text(c), "<[^>]+>", " "))


#: Other names of collections.
COLLECTIONS = {
    "blanket": "Blanket",
    "blankets": "Blanket",
    "body suit": "Bodysuits",
    "bodysuit": "Bodysuits",
    "bodysuits": "Bodysuits",
    "dress": "Dresses",
    "dresses": "Dresses",
    "dreeses": "Dresses",
    "dungaree set": "Dungrees & sets",
    "dungarees set": "Dungrees & sets",
    "dungrees & sets": "Dungrees & sets",
    "hospital set": "Hospital sets",
    "hospital sets": "Hospital sets",
    "jacket": "Jackets",
    "leggings": "Trousers & Leggings",
    "pyjama": "Pyjamas & Homewear",
    "pyjamas": "Pyjamas & Homewear",
    "pramsuit": "Pramsuits & Snowsuits",
    "romper": "Rompers",
    "rompers": "Rompers",
    "shoes": "Footwear",
    "sleepsuit": "Sleepsuits",
    "sleepsuits": "Sleepsuits",
    "snowsuit": "Pramsuits & Snowsuits",
    "t-shirts": "Tops & T-shirts",
    "tops & t-shirts": "Tops & T-shirts",
}


def collection(c: Column, path: Column | None = None, aliases: dict[str, str] = COLLECTIONS) -> Column:
    """A collection's common name; without one, a shirt's page is a top's, and the rest is General."""
    t = F.trim(text(c))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    shirt = F.lit(False) if path is None else (t == "") & F.coalesce(path, F.lit("")).rlike("(?i)(?:^|[-/])shirts?(?:[-/]|$)")
    return F.when(shirt, "Tops & T-shirts").otherwise(F.coalesce(F.try_element_at(known, F.lower(t)), F.nullif(t, F.lit("")), F.lit("General")))


def row_number_in(reason: Column) -> Column:
    """The spreadsheet row that a reason names."""
    return F.try_to_number(F.nullif(F.regexp_extract(text(reason), r"(?i)\brow\s*#?\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")


def truncated(c: Column, most: int) -> Column:
    return F.substring(text(c), 1, most)
