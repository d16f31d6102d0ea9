"""Rules that records must pass, and detectors of what a page is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import clean, label, text, visible_text


def issues(rules: list[tuple[Column, str | Column]]) -> Column:
    """Messages of the rules that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(bad, m if isinstance(m, Column) else F.lit(m)) for bad, m in rules])))


def first_issue(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(bad, m) for bad, m in rules])


def valid_price(p: Column) -> Column:
    return F.coalesce((p > 0) & (p < float("inf")) & ~F.isnan(p), F.lit(False))


def _repeated(values: Column) -> Column:
    fine = F.filter(values, lambda v: v != "")
    return F.size(fine) > F.size(F.array_distinct(fine))


def signature(v: Column, i: Column) -> Column:
    """What makes a variant itself: its options, else its source id, SKU or place."""
    named = F.array_sort(F.transform(F.map_entries(F.coalesce(v["options"], F.create_map().cast("map<string,string>"))), lambda e: F.concat(label(e["key"]), F.lit(":"), label(e["value"]))))
    named = F.filter(named, lambda s: ~s.startswith(":") & ~s.endswith(":"))
    own = F.array_compact(F.array(F.when(label(v["color"]) != "", F.concat(F.lit("color:"), label(v["color"]))), F.when(label(v["size"]) != "", F.concat(F.lit("size:"), label(v["size"])))))
    parts = F.concat(named, own)
    return F.when(F.size(parts) > 0, F.array_join(parts, "|")).otherwise(
        F.coalesce(F.concat(F.lit("source:"), F.nullif(label(v["source_id"]), F.lit(""))), F.concat(F.lit("sku:"), F.nullif(label(v["sku"]), F.lit(""))), F.concat(F.lit("index:"), i.cast("string")))
    )


def catalog_issues(url: Column, title: Column, supplier: Column, supplier_fits: Column, currency: Column, price: Column, fallback: Column, variants: Column, images: Column) -> Column:
    """All that speaks against a catalog record.

    variants: array<struct<sku,source_id,color,size,options map,price,image_url>>; images: array of URLs. A variant
    without a price of its own has the product's.
    """
    u, low, t, money = clean(url), F.lower(clean(url)), clean(title), F.upper(F.trim(text(currency)))
    on = lambda s: F.contains(low, F.lit(s))
    v = F.coalesce(variants, F.array().cast("array<struct<sku:string,source_id:string,color:string,size:string,options:map<string,string>,price:double,image_url:string>>"))
    bad = F.filter(F.transform(v, lambda x, i: F.when(~valid_price(F.coalesce(x["price"], price)), F.concat(F.lit("variant #"), (i + 1).cast("string"), F.lit(" has invalid price")))), lambda m: m.isNotNull())
    http = F.filter(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda x: F.trim(text(x))), lambda x: x.rlike("(?i)^https?://"))
    pictured = F.exists(v, lambda x: text(x["image_url"]).rlike(r"(?i)^\s*https?://"))
    challenge = "(?i)too many requests|exceeds our limit|risk/challenge|risk challenge|captcha|security verification|access denied|forbidden"
    head = issues([
        (~urls.is_http(u), "missing/invalid product source URL"),
        (F.length(t) < 3, "missing/invalid product title"),
        (clean(supplier) == "", "missing supplier name"),
        (~F.coalesce(supplier_fits, F.lit(False)), "supplier does not match source URL domain"),
        (~money.rlike("^[A-Z]{3}$"), "missing/invalid currency code"),
        (~valid_price(price), "invalid product price"),
        (on("centrepointstores.com") & F.coalesce(fallback, F.lit(False)) & ((money != "AED") | (price <= 1)), "untrusted Centrepoint reader fallback price"),
        (on("ae.hm.com") & ((money != "AED") | (price < 10)), "untrusted H&M UAE product price"),
        (on("shein.com") & ~money.isin("AED", "USD"), "untrusted SHEIN product currency"),
        (on("shein.com") & t.rlike(challenge), "SHEIN challenge/rate-limit page was parsed as product"),
        (F.size(v) == 0, "product has no variants"),
    ])
    tail = issues([
        (_repeated(F.transform(v, signature)), "duplicate variant options detected"),
        (_repeated(F.transform(v, lambda x: label(x["sku"]))), "duplicate variant SKU detected"),
        (_repeated(F.transform(v, lambda x: label(x["source_id"]))), "duplicate source variant id detected"),
        (F.size(http) > F.size(F.array_distinct(http)), "duplicate product images detected"),
        ((F.size(http) == 0) & ~pictured, "product has no valid images"),
    ])
    return F.array_distinct(F.concat(head, bad, tail))


# fixed values: what no title, description or option value may hold
MARKUP = r"(?i)</?(?:script|style|html|body)\b|javascript:|personalisationScript"
ODD_OPTION = r"(?i)<[^>]+>|https?://|\b(?:aed|egp|price|add to|description|javascript|undefined|null)\b"


def sync_gate(multiplier: Column, currency: Column, price: Column, title: Column, description: Column, images: Column, variants: Column) -> Column:
    """The first reason that keeps a fresh product out; null if it may go on."""
    v = variants
    skus = F.transform(v, lambda x: F.lower(clean(x["sku"])))
    prices = F.transform(v, lambda x: F.coalesce(F.nullif(x["price"], F.lit(0.0)), price))
    values = F.filter(F.flatten(F.transform(v, lambda x: F.concat(F.array(clean(x["color"]), clean(x["size"])), F.transform(F.map_values(F.coalesce(x["options"], F.create_map().cast("map<string,string>"))), clean)))), lambda s: s != "")
    basic = (currency != "AED") | ~(price > 1) | (clean(title) == "") | (clean(F.regexp_replace(text(description), "<[^>]+>", " ")) == "") | (F.size(images) == 0) | (F.size(v) == 0) | (F.size(v) > 100)
    return first_issue([
        (~F.coalesce(multiplier.isin(22, 23, 24), F.lit(False)), "Product has no approved sheet multiplier"),
        (F.coalesce(basic, F.lit(True)), "Fresh source failed the strict catalog quality gate"),
        (F.exists(images, lambda x: ~urls.is_product_image(x)), "Suspicious source image rejected"),
        (F.exists(skus, lambda s: s == "") | (F.size(F.array_distinct(skus)) < F.size(skus)), "Fresh source has empty or duplicate deterministic SKUs"),
        (clean(title).rlike(MARKUP) | text(description).rlike(MARKUP), "Fresh source title or description contains executable markup"),
        (F.exists(prices, lambda p: ~F.coalesce((p > 1) & (p <= 10000), F.lit(False))), "Fresh source contains an implausible or missing AED variant price"),
        (F.array_max(prices) / F.array_min(prices) > 8, "Fresh source variant price spread is implausibly large"),
        (F.exists(values, lambda s: (F.length(s) > 100) | s.rlike(ODD_OPTION)), "Fresh source contains a suspicious color or size value"),
        ((F.size(v) > 1) & F.exists(values, lambda s: s.rlike("(?i)^default(?: title| 1)?$")), "Fresh multi-variant source contains a placeholder option value"),
    ])


# fixed values: what a page that keeps robots out says, in its source or in its visible text
IN_SOURCE = {
    "captcha": ("captcha", "recaptcha", "hcaptcha", "turnstile", "verify you are human", "prove you are human", "i am not a robot"),
    "bot": ("cf-chl-", "cf-browser-verification", "challenge-form", "datadome", "perimeterx", "incapsula", "attention required", "checking your browser before accessing", "security check to access", "please enable cookies"),
}
IN_TEXT = {
    "login": ("login required", "please log in", "please sign in", "authentication required", "sign in to continue", "member login"),
    "denied": ("access denied", "forbidden", "permission denied", "you don't have permission", "not authorized", "request blocked"),
    "bot": ("verify you are human", "unusual traffic", "automated requests", "ddos protection", "security service"),
    "geo": ("not available in your country", "not available in your region", "geo blocked", "geographic restriction", "country restriction"),
    "rate": ("too many requests", "temporarily blocked", "request limit exceeded", "rate limit exceeded", "retry later", "try again later"),
}
BY_STATUS = {"denied": (401, 403), "rate": (429,)}
CODES = {"captcha": "CAPTCHA_DETECTED", "login": "LOGIN_REQUIRED", "denied": "ACCESS_DENIED", "bot": "BOT_PROTECTION", "geo": "GEO_BLOCKED", "rate": "MANUAL_REVIEW_REQUIRED"}


def restrictions(html: Column, status: Column) -> dict[str, Column]:
    """captcha, login, denied, bot, geo, rate: whether a page says so."""
    body = F.lower(text(html))
    shown = visible_text(body)
    has = lambda c, words: reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False))
    return {k: has(body, IN_SOURCE.get(k, ())) | has(shown, IN_TEXT.get(k, ())) | F.coalesce(status.isin(*BY_STATUS.get(k, (-1,))), F.lit(False)) for k in CODES}


def warning_code(found: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(found[k], code) for k, code in CODES.items()])


# fixed values: errors that say that a site keeps readers out (named ones of single providers are left out), and that a page is gone
BLOCKED = r"(?i)HTTP 403|Access Denied|permission to access|Forbidden|Cloudflare|security verification|captcha|SOURCE_BLOCKED|blocked automated server access|returned a blocked page|timed out|timeout|ECONNRESET|ENOTFOUND"
GONE = r"(?i)HTTP 404|Target URL returned error 404|404\s*\|\s*Page Not Found|Title:\s*(?:404|Page Not Found)|Page Not Found|product (?:was )?(?:removed|deleted|not found)|not available anymore|Oops[,'’]?\s+something(?:'s|\s+has)?\s+gone\s+wrong"


def source_gone(code: Column, status: Column, message: Column) -> Column:
    """Whether an error means that the source no longer exists; signs of blocking veto."""
    c, m = clean(code), clean(message)
    return (
        F.when(c.rlike("(?i)^SOURCE_(?:GONE|NOT_FOUND|REMOVED)$"), True)
        .when(c.rlike("(?i)SOURCE_BLOCKED") | m.rlike(BLOCKED), False)
        .when(status == 404, True)
        .otherwise(m.rlike(GONE))
    )


# fixed values: words that make a product one of the season
SUMMER = r"(?i)(^|[\s_-])summer([\s_-]|$)"
SEASONAL = r"(?i)(^|[\s_-])(summer|swim(?:suit|wear|ming)?|bikini|tankini|rash[\s_-]?(?:vest|guard|suit)|sunsafe|sunsuit|beach|pool|sandals?|flip[\s_-]?flops?|sliders?|slides|shorts|sun[\s_-]?hat|bucket[\s_-]?hat|straw[\s_-]?hat|sun[\s_-]?cap|boardshorts?|swim[\s_-]?trunks?|water[\s_-]?shoes?)([\s_-]|$)"


def season_reasons(title: Column, handle: Column, kind: Column, tags: Column) -> Column:
    whole = F.concat_ws(" ", text(title), text(handle), text(kind), F.array_join(tags, " "))
    return issues([
        (text(title).rlike(SUMMER) | text(handle).rlike(SUMMER), "summer_title"),
        (text(kind).rlike(SUMMER), "summer_product_type"),
        (F.exists(tags, lambda t: t.rlike(SUMMER)), "summer_tag"),
        (whole.rlike(SEASONAL), "summer_seasonal_category"),
    ])


def extraction_warnings(title: Column, price: Column, images: Column, variants: Column, options: Column, raw_price: Column, currency: Column, skus: Column, confidence: Column) -> Column:
    """Codes of what an extracted record lacks. images, variants, options: how many."""
    some = F.filter(skus, lambda s: text(s) != "")
    return issues([
        (text(title) == "", "MISSING_TITLE"),
        (price.isNull(), "MISSING_PRICE"),
        (images == 0, "MISSING_IMAGES"),
        ((variants == 0) & (options == 0), "NO_VARIANTS"),
        ((text(raw_price) != "") & price.isNull(), "PRICE_PARSE_FAILED"),
        (F.coalesce(price != 0, F.lit(False)) & (text(currency) == ""), "CURRENCY_UNKNOWN"),
        (F.size(F.array_distinct(some)) < F.size(some), "DUPLICATE_SKU"),
        (confidence < 70, "LOW_CONFIDENCE"),
    ])


def all_sold_out(sold_out: Column) -> Column:
    """Aggregate: whether every variant is sold out; false for none."""
    return F.coalesce(F.bool_and(F.coalesce(sold_out, F.lit(False))), F.lit(False))


def sellability(tracked: Column, quantity: Column, free: Column) -> Column:
    """Aggregate: unknown where a variant's tracking or stock is, sellable if any is untracked or free to sell."""
    number = quantity.cast("double")
    unknown = F.bool_or(tracked.isNull() | number.isNull() | F.isnan(number))
    return F.when(F.coalesce(unknown, F.lit(True)), "unknown").when(F.bool_or(~tracked | free), "sellable").otherwise("not_sellable")


def price_stock_target(multiplier: Column, skus: Column, sheet: Column, known_sheets: Column, row_number: Column) -> Column:
    """Whether price sync may touch a product: an approved multiplier, some SKU, and a known sheet, or without one a row number."""
    place = F.when(F.coalesce(sheet, F.lit("")) != "", F.array_contains(known_sheets, sheet)).otherwise(F.coalesce(row_number > 0, F.lit(False)))
    return multiplier.isNotNull() & F.exists(skus, lambda s: text(s) != "") & place


def stored_usable(url: Column, stored_url: Column, title: Column, price: Column, images: Column, variants: Column) -> Column:
    """Whether a stored product can stand in for a page: the same URL, a title, a price, and images and variants (how many)."""
    same = urls.canonical_link(url) == urls.canonical_link(stored_url)
    return F.coalesce(same, F.lit(False)) & (F.length(clean(title)) > 5) & valid_price(price) & (images > 0) & (variants > 0)


def capability_warnings(found: dict[str, Column], robots_allow: Column, restricted: Column) -> Column:
    """What speaks against reading a source: found as signals() of a page has it."""
    static = found["json_ld"] | found["embedded"] | found["static"]
    return issues([(~robots_allow, "ROBOTS_DISALLOWED"), (restricted, "RESTRICTED"), (~(found["json_ld"] | found["embedded"]), "NO_STRUCTURED_DATA"), (~static, "NO_PRODUCT_DATA"), (found["browser"] & ~static, "BROWSER_NEEDED")])


def media_issues(images: Column, colors: Column, least: int = 5) -> Column:
    """What a brand's sample product lacks: images that differ, and variants (colors: one each) with a colour."""
    fine = F.array_distinct(F.filter(images, urls.is_http))
    return issues([(F.size(fine) < least, "too few images"), (F.size(fine) < F.size(images), "images repeat or are no URLs"), (~F.exists(colors, lambda c: clean(c) != ""), "no colour")])


def readiness(title: Column, price: Column, images: Column, confidence: Column) -> Column:
    """ready, review or rejected."""
    return F.when((text(title) == "") | price.isNull(), "rejected").when((images > 0) & (confidence >= 70), "ready").otherwise("review")


def strategy(found: dict[str, Column], restricted: Column) -> Column:
    """struct<strategy,confidence>: how a source is best read. Confidence has a floor for strong signals and a cap for restricted ones."""
    said = lambda name, sure: F.struct(F.lit(name).alias("strategy"), F.lit(sure).alias("confidence"))
    return (
        F.when(restricted, said("manual_review", 20))
        .when(found["json_ld"], said("json_ld", 90))
        .when(found["embedded"], said("embedded_state", 80))
        .when(found["static"], said("static_html", 70))
        .when(found["browser"], said("browser_rendering", 45))
        .otherwise(said("manual_review", 30))
    )


#: Fixed values: (mode, parallel requests, requests a minute, products a run).
LIMITS = (("blocked", 0, 0, 0), ("careful", 1, 4, 20), ("normal", 2, 8, 50), ("open", 3, 10, 80))


def safe_mode(robots_allow: Column, restricted: Column, confidence: Column) -> Column:
    return F.when(~robots_allow, "blocked").when(restricted | (confidence < 40), "careful").when(confidence < 70, "normal").otherwise("open")
