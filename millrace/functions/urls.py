"""URLs as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, compact, squeezed, text

TRACKING = r"(?i)^(?:utm_|gclid|fbclid|ref|source)"
TRACKING_IMAGES = r"(?i)^(?:utm_|fbclid|gclid|_branch|irclickid)"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def scheme(url: Column) -> Column:
    return F.lower(part(url, "PROTOCOL"))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def domain(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable(url: Column) -> Column:
    """The host as SQL reports group by it: what follows the scheme, up to a slash."""
    return F.split_part(F.regexp_replace(F.lower(text(url)), r"^https?://(?:www\.)?", ""), F.lit("/"), F.lit(1))


def on_domain(url: Column, name: str) -> Column:
    return F.coalesce((host(url) == name) | host(url).endswith(f".{name}"), F.lit(False))


def is_http(url: Column) -> Column:
    return clean(url).rlike(r"(?i)^https?://[^\s/]+")


def _port(url: Column) -> Column:
    """:port as the URL has it, but for the scheme's own."""
    p = F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    own = ((scheme(url) == "http") & (p == ":80")) | ((scheme(url) == "https") & (p == ":443"))
    return F.when(own, "").otherwise(p)


def _query_without(url: Column, names: str) -> Column:
    kept = F.filter(F.split(part(url, "QUERY"), "&"), lambda kv: ~F.split_part(kv, F.lit("="), F.lit(1)).rlike(names) & (kv != ""))
    joined = F.array_join(kept, "&")
    return F.coalesce(F.when(joined != "", F.concat(F.lit("?"), joined)), F.lit(""))


def canonical_link(url: Column) -> Column:
    """Form A: no fragment, tracking parameters or slashes at the end, m. as www., all in lower case."""
    u = F.regexp_replace(clean(url), r"[),.;]+$", "")
    h = F.regexp_replace(host(u), r"^m\.", "www.")
    path = F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", "")
    query = _query_without(u, TRACKING)
    whole = F.concat(scheme(u), F.lit("://"), h, _port(u), F.when((path == "") & (query != ""), "/").otherwise(path), query)
    plain = F.regexp_replace(clean(url), "/$", "")
    return F.lower(F.coalesce(F.regexp_replace(whole, "/$", ""), plain))


def canonical_source(url: Column) -> Column:
    """Form B: no fragment, query or slashes at the end; the path keeps its case."""
    u = clean(url)
    whole = F.concat(scheme(u), F.lit("://"), host(u), _port(u), F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", ""))
    return F.coalesce(whole, u)


def canonical_cache(url: Column) -> Column:
    """Form C: no fragment, and no sq parameter on one vendor's hosts."""
    u = clean(url)
    plain = F.regexp_replace(u, "#.*$", "")
    without = F.concat(F.regexp_replace(plain, r"\?.*$", ""), _query_without(plain, "^sq$"))
    return F.when(F.coalesce(F.contains(host(u), F.lit("next.")), F.lit(False)), without).otherwise(plain)


def query_value(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))


#: Vendor by a piece of the host, first hit wins: (piece, supplier, SKU brand, vendor key).
HOSTS = (
    ("next.", "Next", "NXT", "NEXT"),
    ("hm.com", "H&M", "HM", "HM"),
    ("maxfashion", "Max", "MAX", "MAX"),
    ("centrepoint", "Centrepoint", "CPT", "CENTREPOINT"),
    ("shein", "SHEIN", "SHN", "SHEIN"),
    ("lefties", "Lefties", "LFT", "LEFTIES"),
    ("marksandspencer", "Marks & Spencer", "MNS", "MARKSANDSPENCER"),
)
MORE_HOSTS = (("carters", "CARTERS"), ("zara", "ZARA"), ("adidas", "ADIDAS"), ("mothercare", "MOTHERCARE"), ("gap.", "GAP"))


def _by_host(url: Column, pairs: list[tuple[str, str]], other: Column) -> Column:
    h = F.coalesce(host(url), F.lit(""))
    return reduce(lambda out, kv: F.when(F.contains(h, F.lit(kv[0])), kv[1]).otherwise(out), reversed(pairs), other)


def brand_code(url: Column) -> Column:
    return _by_host(url, [(p, b) for p, _, b, _ in HOSTS], F.lit("SRC"))


def supplier(url: Column, vendor: Column) -> Column:
    own = F.coalesce(F.nullif(clean(vendor), F.lit("")), domain(url), F.lit("Unknown Supplier"))
    return _by_host(url, [(p, s) for p, s, _, _ in HOSTS], own)


def vendor_key(url: Column) -> Column:
    return _by_host(url, [(p, v) for p, _, _, v in HOSTS] + list(MORE_HOSTS), F.lit(""))


def currency(url: Column) -> Column:
    h, p = F.coalesce(host(url), F.lit("")), F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    return (
        F.when(h.endswith(".ae") | F.contains(h, F.lit("ae.hm.com")) | p.rlike("/en-ae(?:/|$)"), "AED")
        .when(h.endswith(".sa") | p.rlike("/en-sa(?:/|$)"), "SAR")
        .when(h.endswith(".co.uk") | p.rlike("/en-gb(?:/|$)"), "GBP")
        .when(h.endswith(".us"), "USD")
        .otherwise("UNKNOWN")
    )


#: Market of a site by its path's locale or its top-level domain.
REGIONS = (("ME", r"(?:\.ae|\.sa|\.qa|\.kw|\.bh|\.om)$", r"/(?:en|ar)-(?:ae|sa|qa|kw|bh|om)(?:/|$)"), ("UK", r"\.uk$", "/en-gb(?:/|$)"), ("US", r"\.us$", "/en-us(?:/|$)"), ("EU", r"\.(?:de|fr|es|it|eu|nl)$", "/(?:de|fr|es|it)(?:/|$)"))


def region(url: Column) -> Column:
    h, p = F.coalesce(host(url), F.lit("")), F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    out = F.lit("GLOBAL")
    for name, _, path in reversed(REGIONS):
        out = F.when(p.rlike(path), name).otherwise(out)
    for name, top, _ in reversed(REGIONS):
        out = F.when(h.rlike(top), name).otherwise(out)
    return out


#: Places of a product's id in a path.
STYLE, DASH_P, P, PAGE = r"(?i)/style/[^/]+/([^/?#]+)", r"(?i)-p-(\d+)\.html", r"(?i)/p/([^/?#]+)", r"(?i)productpage[./-]?(\d{7,15})"


def _first(path: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(compact(F.regexp_extract(path, p, 1)), F.lit("")) for p in patterns], F.lit(""))


def product_code(url: Column) -> Column:
    return _first(F.coalesce(part(url, "PATH"), F.lit("")), STYLE, DASH_P, P)


def source_code(url: Column) -> Column:
    """The first of seven places whose code has 5 to 64 characters."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    patterns = (STYLE, DASH_P, P, r"(?i)-p(\d+)\.html", r"(?i)p(\d+)\.html", r"(?i)/([A-Z0-9]{5,14})\.html$", r"(?i)-([A-Z0-9]{6,12})/?$")
    codes = F.array(*[compact(F.regexp_extract(path, p, 1)) for p in patterns])
    return F.coalesce(F.try_element_at(F.filter(codes, lambda c: F.length(c).between(5, 64)), F.lit(1)), F.lit(""))


def identifiers(url: Column) -> Column:
    """All distinct product ids that the path and query hold: 5 to 64 letters and digits with a digit among them."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    found = F.array(*[compact(F.regexp_extract(path, p, 1)) for p in (STYLE, PAGE, DASH_P, P)], *[compact(query_value(url, k)) for k in ("v1", "pid", "productId", "product_id")])
    return F.array_distinct(F.filter(found, lambda c: F.length(c).between(5, 64) & c.rlike(r"\d")))


def sku_identifiers(sku: Column, vendor: Column) -> Column:
    raw = F.upper(clean(sku))
    code, v = compact(F.regexp_replace(raw, "(?i)-OPTION.*$", "")), compact(vendor)
    whole = F.when(F.length(code).between(5, 64) & code.rlike(r"\d"), code)
    own = (
        F.when(v == "NEXT", F.nullif(F.regexp_extract(code, r"^([A-Z]\d{5})", 1), F.lit("")))
        .when(v == "HM", F.nullif(F.regexp_extract(code, r"^(\d{10})", 1), F.lit("")))
        .when(v == "MOTHERCARE", F.nullif(F.regexp_extract(compact(F.regexp_replace(raw, "^M[-_]?", "")), r"^([A-Z]{2}\d{3})", 1), F.lit("")))
    )
    return F.array_distinct(F.array_compact(F.array(whole, own)))


def sku_prefixes(sku: Column) -> Column:
    """DAB-a-b-, DAB-a-b-c-, ...: every prefix of three or more parts that leaves at least two (three at the least)."""
    s = F.upper(F.regexp_replace(clean(sku), " ", ""))
    parts = F.filter(F.split(s, "-"), lambda x: x != "")
    ends = F.sequence(F.lit(3), F.greatest(F.lit(3), F.size(parts) - 2))
    made = F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "-"), F.lit("-")))
    return F.when(s.startswith("DAB-"), made).otherwise(F.array().cast("array<string>"))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")


def slug_title(url: Column) -> Column:
    """Words of the segment before a `p` segment, if it is a slug."""
    parts = segments(url)
    at = F.array_position(F.transform(parts, lambda s: F.lower(s)), "p")
    slug = F.coalesce(F.when(at > 1, F.try_url_decode(F.try_element_at(parts, (at - 1).cast("int")))), F.lit(""))
    return F.when(slug.rlike("(?i)[a-z]") & F.contains(slug, F.lit("-")), squeezed(F.regexp_replace(slug, "(?i)^buy-", ""))).otherwise("")


def last_segment_title(url: Column) -> Column:
    """Words of the last segment without extension and id."""
    last = F.coalesce(F.try_url_decode(F.try_element_at(segments(url), F.lit(-1))), F.lit(""))
    for pattern in (r"(?i)\.html?$", "(?i)^buy-", r"(?i)-p-?\d+$", r"(?i)c\d+p\d+$", r"(?i)-[a-z]\d{5,9}$"):
        last = F.regexp_replace(last, pattern, "")
    return F.when(last.rlike(r"^-?\d*$"), "").otherwise(squeezed(last))


def urls_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"(?i)https?://[^\s<>\"']+"), F.lit(0)))


#: Parameters that only size an image.
IMAGE_SIZES = r"(?i)^(?:w|h|width|height|wid|hei|q|quality|fit|fmt|format|size)$"
IMAGE_JUNK = r"(?i)logo|icon|sprite|placeholder|payment|visa|mastercard|apple-pay|favicon|blank\."


def canonical_image(url: Column) -> Column:
    u = F.regexp_replace(clean(url), "#.*$", "")
    return F.lower(F.concat(F.regexp_replace(u, r"\?.*$", ""), _query_without(u, IMAGE_SIZES)))


def is_product_image(url: Column) -> Column:
    return is_http(url) & ~text(url).rlike(IMAGE_JUNK)


def image_width(url: Column) -> Column:
    """The width that an image URL names, in its query or as 800x600."""
    q = F.regexp_extract(text(url), r"(?i)[?&](?:w|width|wid)=(\d{1,5})", 1)
    return F.coalesce(F.nullif(q, F.lit("")), F.nullif(F.regexp_extract(text(url), r"(?i)(\d{2,5})x\d{2,5}", 1), F.lit(""))).cast("int")


def sheet_export(url: Column) -> Column:
    """A sheet's address as that of its CSV export; gid from the query, else the fragment, else 0."""
    key = F.regexp_extract(text(url), r"/spreadsheets/d/([A-Za-z0-9_-]+)", 1)
    gid = F.coalesce(F.nullif(F.regexp_extract(text(url), r"[?&]gid=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text(url), r"#.*?gid=(\d+)", 1), F.lit("")), F.lit("0"))
    return F.when(key == "", clean(url)).otherwise(F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), key, F.lit("/export?format=csv&gid="), gid))


# fixed values: what a path says about a page, first hit wins
ASSETS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".pdf", ".ico")
UTILITY = ("/cart", "/checkout", "/account", "/login", "/wishlist", "/search", "/privacy", "/terms", "/help", "/track", "/payment")
PRODUCT = ("/product/", "/products/", "/p/", "/shop/", "-p-", "/item/", "/sku/")
CATEGORY = ("/category/", "/categories/", "/collection/", "/collections/", "/department/", "/departments/", "/c/", "/shop-by/", "/browse/")
PRODUCT_ID = r"/(?:[a-z0-9-]{4,}-)?(?:\d{5,}|[a-z0-9]{8,})(?:\.html)?$"


def page_type(url: Column) -> Column:
    """struct<type,confidence> of a URL."""
    path = F.lower(part(url, "PATH"))
    any_of = lambda words: reduce(lambda a, w: a | F.contains(path, F.lit(w)), words, F.lit(False))
    said = lambda kind, sure: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    return (
        F.when(path.isNull(), said("ignored", 100))
        .when(any_of(ASSETS), said("asset", 100))
        .when(any_of(UTILITY), said("ignored", 95))
        .when(any_of(PRODUCT), said("product", 90))
        .when(path.rlike(PRODUCT_ID), said("product", 78))
        .when(any_of(CATEGORY), said("category", 85))
        .otherwise(said("page", 60))
    )


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Longest fitting rule decides, ties allow; stars in rules are dropped before the comparison; "/" alone forbids all."""
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))

    def fits(rule: Column) -> Column:
        r = F.replace(rule, F.lit("*"), F.lit(""))
        bare = F.regexp_replace(r, r"\$$", "")
        return (rule != "") & ((r == "/") | (p.startswith(bare) & (~r.endswith("$") | p.endswith(bare))))

    best = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, fits), lambda r: F.length(r))), F.lit(-1))
    return ~F.array_contains(disallow, "/") & (best(allow) >= best(disallow))
