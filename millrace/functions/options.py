"""Sizes, colours, options and SKUs as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import clean, compact, label, sku_token, squeezed, text

NUMBER = r"(\d+(?:\.\d+)?)"

#: Fixed values: (pattern over the upper-case text, token; $n is a group), first hit wins.
SIZE_TOKENS = (
    (r"(\d+)\s*CM[^0-9]*(\d+)\s*LB", "$1CM-$2LB"),
    (r"(\d+)\s*CM.*FIRST\s*SIZE", "$1CM-FIRST-SIZE"),
    (r"\bNEW\s*BORN\b|\bNEWBORN\b|\bNB\b", "NB"),
    (rf"UP\s*TO\s*{NUMBER}\s*MONTH", "UP-TO-$1M"),
    (rf"EU\s*{NUMBER}.*?UK\s*{NUMBER}", "EU-$1-UK-$2"),
    (rf"{NUMBER}\s*[-–]\s*{NUMBER}\s*MONTH", "$1-$2M"),
    (rf"(?:^|[^0-9]){NUMBER}\s*MONTH", "$1M"),
    (rf"{NUMBER}\s*[-–]\s*{NUMBER}\s*YEAR", "$1-$2Y"),
    (rf"(?:^|[^0-9]){NUMBER}\s*YEAR", "$1Y"),
    (r"\bONE\s*SIZE\b|\bSIZE\s*ONE\b|^ONE$", "ONE"),
)
#: Further tokens of the lenient form, after EU and UK together.
SIZE_TOKENS_LENIENT = (
    *SIZE_TOKENS[:5],
    (rf"\bEU\s*{NUMBER}", "EU-$1"),
    (rf"\bUK\s*{NUMBER}", "UK-$1"),
    *SIZE_TOKENS[5:],
    ("^(XXS|XS|S|M|L|XL|XXL)$", "$1"),
    (rf"^{NUMBER}$", "$1"),
)


def _filled(raw: Column, pattern: str, made: str) -> Column:
    parts = [F.regexp_extract(raw, pattern, int(p[0])) if i % 2 else F.lit(p) for i, p in enumerate(_cut(made))]
    return F.concat(*parts)


def _cut(made: str) -> list[str]:
    out = [""]
    for ch in made:
        if ch == "$":
            out.append("")
        elif len(out) % 2 == 0 and ch.isdigit() and not out[-1]:
            out[-1] = ch
            out.append("")
        else:
            out[-1] += ch
    return out


def size_token(c: Column, lenient: bool = False) -> Column:
    """A size as one token; null for none, or for what only the lenient form takes as it stands."""
    raw = F.upper(clean(c))
    table = SIZE_TOKENS_LENIENT if lenient else SIZE_TOKENS
    rest = F.nullif(sku_token(c, 20), F.lit("")) if lenient else F.lit(None).cast("string")
    said = reduce(lambda out, row: F.when(raw.rlike(row[0]), _filled(raw, *row)).otherwise(out), reversed(table), rest)
    return F.when(~raw.isin("", "DEFAULT", "DEFAULT TITLE"), said)


LETTER_RANKS = {"XXS": 2000, "XS": 2010, "S": 2020, "M": 2030, "L": 2040, "XL": 2050, "XXL": 2060, "ONE": 5000}


def _value(token: Column, pattern: str) -> Column:
    return F.replace(F.regexp_extract(token, pattern, 1), F.lit("P"), F.lit(".")).try_cast("double")


def _ranked(token: Column, rows: list[tuple[str, object]], other: Column) -> Column:
    return reduce(lambda out, row: F.when(token.rlike(row[0]), row[1]).otherwise(out), reversed(rows), other)


def size_rank_sku(token: Column) -> Column:
    """Order of sizes within a product's SKUs."""
    month, year = r"^(?:UP-TO-)?(\d+(?:P\d+)?)M$", r"^(\d+(?:P\d+)?)Y$"
    letters = [(f"^{k}$", F.lit(float(v))) for k, v in LETTER_RANKS.items()]
    return _ranked(token, [("^NB$", F.lit(-100.0)), (month, _value(token, month)), (year, _value(token, year) * 12), *letters], F.lit(3000.0))


def _rank_rows(token: Column) -> list[tuple[str, object]]:
    n = r"(\d+(?:\.\d+)?)"
    return [
        (r"^\d+CM-\d+LB$", F.lit(-100.0)),
        (r"^\d+CM-FIRST-SIZE$", F.lit(-90.0)),
        ("^NB$", F.lit(-80.0)),
        (f"^UP-TO-{n}M$", _value(token, f"^UP-TO-{n}M$") - 70),
        (f"^{n}-{n}M$", _value(token, f"^{n}-{n}M$")),
        (f"^{n}M$", _value(token, f"^{n}M$")),
        (f"^{n}-{n}Y$", _value(token, f"^{n}-{n}Y$") * 12),
        (f"^{n}Y$", _value(token, f"^{n}Y$") * 12),
    ]


def size_rank_strict(token: Column) -> Column:
    n = r"(\d+(?:\.\d+)?)"
    rows = [*_rank_rows(token), (f"^EU-{n}-UK-", _value(token, f"^EU-{n}-UK-") + 1000), ("^ONE$", F.lit(5000.0))]
    return F.coalesce(_ranked(token, rows, F.lit(float("inf"))), F.lit(float("inf")))


def size_rank_lenient(token: Column) -> Column:
    n = r"(\d+(?:\.\d+)?)"
    rows = [*_rank_rows(token), (f"^EU-{n}", _value(token, f"^EU-{n}") + 1000), (f"^UK-{n}", _value(token, f"^UK-{n}") + 1100), (f"^{n}$", _value(token, f"^{n}$") + 1200)]
    letters = [(f"^{k}$", F.lit(float(v))) for k, v in LETTER_RANKS.items()]
    return F.coalesce(_ranked(token, [*rows, *letters], F.lit(4000.0)), F.lit(float("inf")))


#: Texts that choose nothing.
DEFAULT_VALUE = r"(?i)^(default|default title|one size|choose(?:\s+(?:a|an|your)?\s*(?:option|size|colou?r)?)?|select(?:\s+(?:a|an|your)?\s*(?:option|size|colou?r)?)?|please select(?:\s+.*)?|size guide|size chart)$"
#: Words, forms and ages that are sizes, and what is none.
SIZE_WORDS = r"(?i)^(?:xxxs|xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl|4xl|5xl|small|medium|large|x-?small|x-?large|xx-?large|one size|free size|os|o/s|nb|n/b|newborn|preemie)$"
SIZE_FORMS = (
    r"^\d{1,3}(?:\.\d+)?$",
    r"(?i)^\d+(?:\.\d+)?\s*(?:S|L)$",
    r"(?i)^(?:EU|UK|US)\s*\d{1,3}(?:\.\d+)?(?:\s*\((?:EU|UK|US)\s*\d{1,3}(?:\.\d+)?\))?$",
    r"(?i)^\d{1,3}\s*(?:c|k|t|y)$",
    r"(?i)^\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?(?:\s*(?:cm|mm|in|inch|inches|mths?|months?|yrs?|years?|y|m|mths))?$",
    r"(?i)^(?:up to\s+)?\d+\s*(?:mths?|months?|yrs?|years?|y|m)$",
    r"(?i)^\d+(?:\.\d+)?\s*(?:cm|mm|in|inch|inches)$",
    r"(?i)^\d+\s*(?:y|m|t)$",
)
NOT_SIZES = r"(?i)\b(?:toddler\s+(?:girl|boy)|baby\s+(?:girl|boy)|newborn\s+baby)\b"
AGE_WORDS, NEWBORN = r"(?i)\b(?:months?|mths?|yrs?|years?|newborn|preemie|toddler|baby)\b", r"(?i)\b(?:newborn|preemie)\b"


def is_default(c: Column) -> Column:
    return (clean(c) == "") | clean(c).rlike(DEFAULT_VALUE)


def looks_like_size(c: Column) -> Column:
    v = clean(c)
    form = reduce(lambda a, p: a | v.rlike(p), SIZE_FORMS, v.rlike(SIZE_WORDS))
    aged = v.rlike(AGE_WORDS) & (v.rlike(r"\d") | v.rlike(NEWBORN))
    return (v != "") & ~v.rlike(r"^\d$") & ~v.rlike(NOT_SIZES) & (form | aged)


def looks_like_asset(c: Column) -> Column:
    return clean(c).rlike(r"(?i)^https?://|\.(?:jpe?g|png|webp|gif|svg|css|js)(?:\?|$)")


def looks_like_noise(c: Column) -> Column:
    return clean(c).rlike(r"(?i)\b(?:add to (?:bag|cart|basket)|wish ?list|sign in|size guide|checkout|share|reviews?)\b")


def option_name(c: Column) -> Column:
    v = clean(c)
    return F.when(v.rlike("(?i)^colou?r$"), "Color").when(v.rlike("(?i)^sizes?$"), "Size").otherwise(v)


def labelled(c: Column, name: str) -> Column:
    """The value after a label, without what follows it on the page."""
    word = "colou?r" if name == "Color" else "size"
    got = F.regexp_extract(clean(c), rf"(?i)(?:selected\s+)?{word}\s*(?:is|:|-)?\s*([A-Za-z0-9؀-ۿ][A-Za-z0-9؀-ۿ /&,+.'()-]{{0,70}})", 1)
    return F.trim(F.regexp_replace(clean(got), r"(?i)\s+(?:size|colour|color|price|description|composition|care|share|stock|add to|delivery|shipping)\b.*$", ""))


#: Colours by name.
NAMED_COLORS = {
    "black": "#000000",
    "white": "#FFFFFF",
    "navy": "#000080",
    "blue": "#0000FF",
    "red": "#FF0000",
    "green": "#008000",
    "yellow": "#FFFF00",
    "pink": "#FFC0CB",
    "purple": "#800080",
    "grey": "#808080",
    "gray": "#808080",
    "beige": "#F5F5DC",
    "brown": "#8B4513",
    "orange": "#FFA500",
    "cream": "#FFFDD0",
    "ivory": "#FFFFF0",
    "maroon": "#800000",
    "olive": "#808000",
    "teal": "#008080",
}


def hex_color(c: Column) -> Column:
    """#RRGGBB of an rgb(), hexadecimal or named colour; empty for none and for a transparent one."""
    raw = clean(c)
    rgb = r"(?i)rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})(?:\s*,\s*(0|0?\.\d+|1(?:\.0)?))?\s*\)"
    channel = lambda i: F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(raw, rgb, i).try_cast("int"))), 2, "0")
    alpha = F.regexp_extract(raw, rgb, 4)
    clear = (alpha != "") & (alpha.try_cast("double") == 0)
    digits = F.coalesce(F.nullif(F.regexp_extract(raw, "(?i)^#?([0-9a-f]{3}|[0-9a-f]{6})$", 1), F.lit("")), F.regexp_extract(raw, r"(?i)#([0-9a-f]{6}|[0-9a-f]{3})\b", 1))
    long = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    known = F.create_map(*[F.lit(x) for kv in NAMED_COLORS.items() for x in kv])
    named = F.coalesce(F.try_element_at(known, F.lower(raw)), F.lit(""))
    return F.when(raw.rlike(rgb), F.when(clear, "").otherwise(F.concat(F.lit("#"), channel(1), channel(2), channel(3)))).when(digits != "", F.concat(F.lit("#"), F.upper(long))).otherwise(named)


def color_value(c: Column) -> Column:
    """A colour's name without label, default texts and assets."""
    v = F.regexp_replace(clean(c), r"(?i)^(?:selected\s+)?colou?r\s*[:\-]?\s*", "")
    return F.when(is_default(v) | looks_like_asset(v) | looks_like_noise(v), "").otherwise(v)


def option_key(options: Column) -> Column:
    """name=value of a map in order of names, joined by a bar."""
    pairs = F.transform(F.map_entries(options), lambda e: F.concat(label(e["key"]), F.lit("="), label(e["value"])))
    return F.array_join(F.array_sort(pairs), "|")


def option_names(names: Column) -> Column:
    """Color and Size first, then the others as they come; three at most; Title where there is none."""
    own = F.array_distinct(F.transform(names, lambda n: F.when(n == "Colour", "Color").otherwise(n)))
    first = F.array_intersect(F.array(F.lit("Color"), F.lit("Size")), own)
    ordered = F.slice(F.array_union(first, own), 1, 3)
    return F.when(F.size(ordered) > 0, ordered).otherwise(F.array(F.lit("Title")))


def match_keys(variant_id: Column, sku: Column, color: Column, size: Column, options: Column) -> Column:
    """Keys that variants are matched by, strongest first."""
    v, s, c, z = label(variant_id), label(sku), label(color), label(size)
    return F.array_compact(F.array(
        F.when(v != "", F.concat(F.lit("source:"), v)),
        F.when(s != "", F.concat(F.lit("sku:"), s)),
        F.when((c != "") | (z != ""), F.concat(F.lit("combo:"), c, F.lit("|"), z)),
        F.when(text(options) != "", F.concat(F.lit("options:"), options)),
    ))


def short_hash(c: Column, n: int = 8) -> Column:
    return F.upper(F.substring(F.sha1(clean(c).cast("binary")), 1, n))


def formatted_code(code: Column) -> Column:
    c = compact(code)
    return F.when(F.length(c) <= 3, c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("-"), F.substring(c, F.length(c) - 2, F.lit(3))))


def bounded_code(code: Column, identity: Column) -> Column:
    """A formatted code of 26 characters at most; a longer one keeps 17 and a hash of the product's identity."""
    made = formatted_code(code)
    return F.when(F.length(made) <= 26, made).otherwise(F.concat(F.substring(compact(code), 1, 17), F.lit("-"), short_hash(identity, 8)))


def product_code(url: Column, product_id: Column) -> Column:
    brand, own, given = urls.brand_code(url), urls.product_code(url), compact(product_id)
    color = compact(urls.query_value(url, "colorId"))
    raw = F.when((brand == "NXT") & (own != ""), own).otherwise(F.coalesce(F.nullif(given, F.lit("")), own))
    raw = F.when((brand == "LFT") & (raw != "") & (color != ""), F.concat(raw, color)).otherwise(raw)
    identity = F.concat_ws("|", brand, clean(product_id), urls.canonical_source(url), color)
    return F.when(raw != "", bounded_code(raw, identity)).otherwise(short_hash(urls.canonical_source(url), 10))


def multiplier_token(m: Column) -> Column:
    plain = F.regexp_replace(m.cast("double").cast("string"), r"\.0+$", "")
    return F.when(m > 0, F.regexp_replace(plain, r"\.", "P")).otherwise("1")


def base_sku(brand: Column, code: Column, size: Column, multiplier: Column) -> Column:
    token = F.coalesce(F.nullif(sku_token(size, 20), F.lit("")), F.lit("ONE"))
    return F.substring(F.concat_ws("-", F.lit("DAB"), brand, code, token, multiplier_token(multiplier)), 1, 64)


def is_dab_sku(c: Column) -> Column:
    return clean(c).rlike("(?i)^DAB-[A-Z0-9]+-[A-Z0-9-]+$")


#: Fixed values: (first month, last month, label) of the baby sizes.
LADDER = (
    (0, 1, "Up to 1 Month (50-56cm)"),
    (0, 3, "0-3 Months (56-62cm)"),
    (3, 6, "3-6 Months (62-68cm)"),
    (6, 9, "6-9 Months (68-74cm)"),
    (9, 12, "9-12 Months (74-80cm)"),
    (12, 18, "12-18 Months (80-86cm)"),
    (18, 24, "1.5-2 Years (86-92cm)"),
    (24, 36, "2-3 Years (92-98cm)"),
    (36, 48, "3-4 Years (98-104cm)"),
    (48, 60, "4-5 Years (104-110cm)"),
    (60, 72, "5-6 Years (110-116cm)"),
    (72, 84, "6-7 Years (116-122cm)"),
    (84, 96, "7-8 Years (122-128cm)"),
    (96, 108, "8-9 Years (128-134cm)"),
    (108, 120, "9-10 Years (134-140cm)"),
    (120, 132, "10-11 Years (140-146cm)"),
    (132, 144, "11-12 Years (146-152cm)"),
)


def age_range(c: Column) -> Column:
    """struct<low,high> in months of the ages that a title names; high is 0 without any."""
    english, n = r"(?i)(\d+)\s*(?:mths?|months?)\s*-\s*(\d+)\s*(?:yrs?|years?)", lambda t, p, i: F.get(F.regexp_extract_all(t, F.lit(p), F.lit(i)), F.lit(0)).try_cast("int")  # a null costs nothing to cast, "" an exception
    up_to, arabic = r"(?i)up to\s*(\d+)\s*-\s*(\d+)\s*years?", r"(?:0\s*(?:شهر|شهور))\s*-\s*(\d+)\s*(?:سنة|سنتين|سنوات)"

    def read(t: Column) -> Column:
        years = F.coalesce(F.nullif(n(t, english, 2), F.lit(0)), n(t, up_to, 2), n(t, arabic, 1), F.when(t.rlike("(?i)baby|babies|بيبي"), 3), F.lit(0))
        return F.struct(F.coalesce(n(t, english, 1), F.lit(0)).alias("low"), (years * 12).alias("high"))

    return F.get(F.transform(F.array(clean(c)), read), F.lit(0))


def size_ladder(c: Column) -> Column:
    """Labels of the sizes that lie within a title's ages, which are read once: a step would read them anew from the title."""
    steps = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(name).alias("name")) for a, b, name in LADDER])
    within = lambda ages: F.transform(F.filter(steps, lambda s: (s["low"] >= ages["low"]) & (s["high"] <= ages["high"])), lambda s: s["name"])
    return F.get(F.transform(F.array(age_range(c)), within), F.lit(0))


#: Words that a product is called by.
PRODUCT_WORDS = r"(?i)\b(?:tops?|t-?shirts?|shirts?|shorts?|set|dress(?:es)?|romper|dungaree|outfit|sleepsuit|bodysuit|leggings?|joggers?|jeans|trousers|sandals?|shoes?|trainers?|boots?|cardigan|jumper|sweatshirts?|sweater|hoodie|coat|jacket|swimsuit|pyjamas?|pajamas?)\b"


def title_color(c: Column) -> Column:
    """What a title says before its first product word, if that can be a colour; else null."""
    t = F.regexp_replace(F.regexp_replace(clean(c), r"\s+-\s+", " "), r"(?i)\s+(?:from|by)\s+Next$", "")
    head = clean(F.regexp_extract(t, rf"^(.*?){PRODUCT_WORDS.replace('(?i)', '(?i:')})", 1))
    bad = head.rlike(r"(?i)\b(?:baby|kids?|girls?|boys?|maman|bébé|cotton|pack|piece|printed?)\b")
    return F.when((head != "") & (F.length(head) <= 48) & ~bad, F.trim(F.regexp_replace(head, r"(?i)^(?:Next|Lipsy|Reiss|Baker by Ted Baker)\s+", "")))


def stock_status(available: Column, said: Column) -> Column:
    return F.when(~F.coalesce(available, F.lit(False)), "out_of_stock").when(said.isin("out_of_stock", "low_stock", "in_stock"), said).otherwise("unknown")


def value_in_title(title: Column, values: Column) -> Column:
    """The longest of an option's values that stands in a title as whole words; null for none."""
    pad = lambda x: F.concat(F.lit(" "), squeezed(x), F.lit(" "))
    found = F.filter(values, lambda v: (squeezed(v) != "") & F.contains(pad(title), pad(v)))
    ordered = F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.try_element_at(ordered, F.lit(1))["v"]
