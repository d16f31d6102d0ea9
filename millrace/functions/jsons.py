"""JSON texts, fingerprints and times as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label, text


def recovered(c: Column) -> Column:
    """A JSON text without comment marks around it and commas before closing brackets."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"^\s*<!--", ""), r"-->\s*$", "")
    return F.trim(F.regexp_replace(t, r",\s*([}\]])", "$1"))


def parsed(c: Column) -> Column:
    """A JSON text as a variant, repaired if need be; null if it still is none."""
    return F.coalesce(F.try_parse_json(text(c)), F.try_parse_json(recovered(c)))


def field(c: Column, path: str, default: str | None = None) -> Column:
    got = F.get_json_object(c, path)
    return got if default is None else F.coalesce(got, F.lit(default))


def merged(old: Column, new: Column) -> Column:
    """Two flat JSON objects as one, the new one's values first, its nulls left out."""
    kind = "map<string,string>"
    a, b = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    fresh = F.map_filter(b, lambda _, v: v.isNotNull())
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(fresh, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, fresh)))))


def as_list(c: Column) -> Column:
    """A JSON array of strings, or a text cut at commas and bars, as an array without blanks."""
    made = F.coalesce(F.from_json(c, "array<string>"), F.split(text(c), r"[|,]"))
    return F.filter(F.transform(made, lambda x: F.trim(x)), lambda x: x != "")


def fingerprint(url: Column, price: Column, multiplier: Column, collection: Column, sku: Column) -> Column:
    """SHA-1 of a sheet row's content."""
    number = lambda c, f: F.coalesce(F.format_string(f, c), F.lit(""))
    parts = F.concat_ws("|", url, F.when(price.isNull(), "").otherwise(number(price, "%.2f")), F.when(multiplier.isNull(), "").otherwise(number(multiplier, "%.4f")), label(collection), F.upper(F.trim(text(sku))))
    return F.sha1(parts.cast("binary"))


def cutoff(now: Column, interval: str) -> Column:
    return now - F.expr(f"INTERVAL {interval}")


def cycle_start(now: Column, day: int) -> Column:
    """When the billing cycle that holds `now` began: on day 1 to 28 of this month or the one before."""
    own = min(28, max(1, day))
    this = F.date_add(F.trunc(now.cast("date"), "month"), own - 1)
    return F.when(now.cast("date") >= this, this).otherwise(F.add_months(this, -1)).cast("timestamp")


def cycle_days(now: Column, day: int) -> Column:
    start = cycle_start(now, day).cast("date")
    return F.greatest(F.lit(1), F.datediff(F.add_months(start, 1), start))


def heartbeat(result: Column, started: Column, created: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.get_json_object(result, "$.lastPageAt")), started, created)
