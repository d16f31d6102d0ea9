"""Numbers, prices and currencies as Column functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean, once, text

EASTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬"
WESTERN = "01234567890123456789.,"


def _number(token: Column) -> Column:
    """A digits-and-separators token as a number: the last separator is decimal if both kinds occur, or with 1 or 2 digits after it."""
    last = F.regexp_extract(token, r"([.,])[^.,]*$", 1)
    tail = F.length(F.regexp_extract(token, r"[.,]?([^.,]*)$", 1))
    both = F.contains(token, F.lit(".")) & F.contains(token, F.lit(","))
    decimal = (last != "") & (both | tail.between(1, 2))
    whole = F.regexp_replace(F.regexp_extract(token, r"^(.*)[.,][^.,]*$", 1), "[.,]", "")
    joined = F.concat(whole, F.lit("."), F.regexp_extract(token, r"[.,]([^.,]*)$", 1))
    return F.when(decimal, joined).otherwise(F.regexp_replace(token, "[.,]", "")).try_cast("double")


def _western(c: Column) -> Column:
    return F.regexp_replace(F.translate(text(c), EASTERN, WESTERN), r"(?U)\s+", "")


def localized_number(c: Column) -> Column:
    """The first number in a text of any of three digit systems; null without one."""
    return once(_western(c), lambda t: once(F.regexp_substr(t, F.lit(r"\d[\d.,]*")), _number))


def localized_money(c: Column) -> Column:
    """The first positive number of a text, 0 without one."""
    found = F.regexp_extract_all(F.translate(text(c), EASTERN, WESTERN), F.lit(r"(?U)\d[\d.,\s]*"), F.lit(0))
    numbers = F.transform(found, lambda t: _number(F.regexp_replace(t, r"(?U)\s+", "")))
    return F.coalesce(F.try_element_at(F.filter(numbers, lambda x: x > 0), F.lit(1)), F.lit(0.0))


def simple_prices(c: Column) -> Column:
    """All numbers of a text whose commas only group."""
    return F.transform(F.regexp_extract_all(F.replace(text(c), F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def simple_price(c: Column) -> Column:
    return F.coalesce(F.try_element_at(simple_prices(c), F.lit(1)), F.lit(0.0))


def price_range(c: Column) -> Column:
    p = simple_prices(c)
    return F.struct(F.coalesce(F.array_min(p), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(p), F.lit(0.0)).alias("max"))


def sheet_price(c: Column) -> Column:
    """A cell's positive number, commas as decimal points; null otherwise."""
    n = F.replace(F.regexp_replace(clean(c), "[^0-9.,-]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(n > 0, n)


def cents_price(c: Column) -> Column:
    """All digits: hundredths; else a simple price."""
    t = clean(c)
    return F.when(t.rlike(r"^\d+$"), t.try_cast("double") / 100).otherwise(simple_price(t))


#: What names a currency, in the two orders that the extractors use.
SIGNALS = (
    ("USD", r"\bUSD\b|\$"),
    ("EUR", r"\bEUR\b|€"),
    ("GBP", r"\bGBP\b|£"),
    ("EGP", r"\bEGP\b|ج\s*\.?\s*م|جنيه"),
    ("AED", r"\bAED\b|د\s*\.?\s*إ|درهم"),
    ("SAR", r"\bSAR\b|ر\s*\.?\s*س|ريال"),
    ("QAR", r"\bQAR\b"),
    ("KWD", r"\bKWD\b"),
    ("BHD", r"\bBHD\b"),
    ("OMR", r"\bOMR\b"),
    ("TRY", r"\bTRY\b|₺|\bTL\b"),
)
REGIONAL_ORDER = ("EGP", "AED", "SAR", "QAR", "KWD", "BHD", "OMR", "MXN", "TRY", "GBP", "EUR", "USD")


def currency(c: Column, fallback: str | None = None) -> Column:
    return reduce(lambda out, kv: F.when(text(c).rlike(f"(?i){kv[1]}"), kv[0]).otherwise(out), reversed(SIGNALS), F.lit(fallback))


def currency_regional(c: Column, fallback: str = "USD") -> Column:
    known = dict(SIGNALS) | {"MXN": r"\bMXN\b"}
    return reduce(lambda out, k: F.when(text(c).rlike(f"(?i){known[k]}"), k).otherwise(out), reversed(REGIONAL_ORDER), F.lit(fallback))


def js_round(c: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(c + 0.5)


@F.pandas_udf(T.DoubleType())
def js_to_fixed2(x: pd.Series) -> pd.Series:
    """toFixed(2) read back: ties by the double's exact value, away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    cent = Decimal("0.01")
    return x.map(lambda v: float(Decimal(v).quantize(cent, ROUND_HALF_UP)) if v == v and abs(v) < 1e21 else v, na_action="ignore").astype("float64")


def cents(c: Column) -> Column:
    """Two decimals without leaving the JVM: equal to toFixed(2) but for doubles that spell a half cent."""
    return F.round(c, 2)


def price_by_rule(base: Column, multiplier: Column, fixed: Column, percent: Column, rounding: Column, least: Column, most: Column) -> Column:
    """base * multiplier + fixed + percent of base, rounded by the rule and kept between its bounds; bounds of 0 are none."""
    p = base * multiplier + fixed + base * percent / 100
    p = F.when(rounding == ".99", F.floor(p) + 0.99).when(rounding == ".00", js_round(p).cast("double")).otherwise(p)
    p = F.when((least != 0) & (p < least), least).otherwise(p)
    return cents(F.when((most != 0) & (p > most), most).otherwise(p))


def money_close(a: Column, b: Column) -> Column:
    return F.coalesce((F.abs(a - b) < 0.01) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def positive(c: Column) -> Column:
    """A text's number if it is finite and above 0. Blank counts as 0, 0x as hexadecimal."""
    t = F.trim(text(c))
    n = F.when(t == "", F.lit(0.0)).when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double")).otherwise(t.try_cast("double"))
    return F.when((n > 0) & (n < float("inf")), n)


def inferred_source_price(price: Column, multiplier: Column) -> Column:
    return F.when(multiplier > 0, F.round(price / multiplier, 4))


def approved_multiplier(recorded: Column, skus: Column) -> Column:
    """22, 23 or 24: as recorded, else as the first SKU that ends in one says."""
    from_sku = F.try_element_at(F.filter(F.transform(skus, lambda s: F.regexp_extract(F.upper(s), r"-(2[234])$", 1)), lambda s: s != ""), F.lit(1)).try_cast("int")
    own = recorded.try_cast("int")
    return F.coalesce(F.when(own.isin(22, 23, 24), own), from_sku)


def quantity(status: Column, explicit: Column, default: int = 10) -> Column:
    """Units on hand: none when sold out, else as said, else by status."""
    s = F.lower(clean(status))
    known = F.when(explicit >= 0, F.floor(explicit).cast("int"))
    return F.when(s.isin("out_of_stock", "sold_out", "unavailable"), 0).otherwise(F.coalesce(known, F.when(s == "low_stock", 1).when(s == "in_stock", default).otherwise(0)))


def confidence(has: dict[str, Column]) -> Column:
    """Score of an extracted record by what it has. The points."""
    points = {"title": 20, "price": 20, "images": 20, "description": 10, "variants": 10, "json_ld": 10, "canonical": 5, "identity": 5}
    return reduce(lambda a, k: a + F.when(has[k], points[k]).otherwise(0), points, F.lit(0)).cast("int")


def signal_confidence(has: dict[str, Column]) -> Column:
    points = {"json_ld": 30, "group": 10, "open_graph": 15, "price_meta": 10, "static": 20, "embedded": 5, "variants": 5, "images": 5}
    score = reduce(lambda a, k: a + F.when(has[k], points[k]).otherwise(0), points, F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.when(has["browser"], F.greatest(F.lit(20), score - 15)).otherwise(score))).cast("int")


def compare_at_issue(price: Column, compare_at: Column) -> Column:
    return F.when(compare_at.isNotNull() & (compare_at <= price), "compare-at price must exceed the price")
