"""The normalisers and the page parsers under SQL names, for queries that are written as text.

Scalar functions are SQL functions, so their bodies are optimised with the query that calls them and no Python runs.
Table functions parse whole texts in Python; they are called with LATERAL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import extraction
from .sources import sheets

#: name, parameters, type and body of each scalar function, in an order in which those that others call come first.
SCALARS = (
    ("text_clean", "s STRING", "STRING", r"trim(regexp_replace(coalesce(s, ''), r'(?U)[\s" + "﻿" + r"]+', ' '))"),
    ("text_label", "s STRING", "STRING", "lower(text_clean(s))"),
    ("text_compact", "s STRING", "STRING", "regexp_replace(upper(text_clean(s)), '[^A-Z0-9]+', '')"),
    ("text_squeezed", "s STRING", "STRING", "lower(trim(regexp_replace(s, '(?i)[^a-z0-9]+', ' ')))"),
    ("text_visible", "html STRING", "STRING", r"text_clean(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), r'(?is)<script.*?</script>', ' '), r'(?is)<style.*?</style>', ' '), r'(?is)<noscript.*?</noscript>', ' '), '<[^>]+>', ' '))"),
    ("sku_token", "s STRING", "STRING", "substring(regexp_replace(regexp_replace(upper(text_clean(s)), '[^A-Z0-9]+', '-'), '^-+|-+$', ''), 1, 24)"),
    ("url_host", "url STRING", "STRING", "lower(try_parse_url(url, 'HOST'))"),
    ("url_domain", "url STRING", "STRING", r"regexp_replace(url_host(url), r'^www\.', '')"),
    ("url_on_domain", "url STRING, name STRING", "BOOLEAN", "coalesce(url_host(url) = name OR endswith(url_host(url), '.' || name), false)"),
    ("url_is_http", "url STRING", "BOOLEAN", r"text_clean(url) RLIKE r'(?i)^https?://[^\s/]+'"),
    ("url_registrable", "url STRING", "STRING", r"split_part(regexp_replace(lower(coalesce(url, '')), r'^https?://(?:www\.)?', ''), '/', 1)"),
    ("money_close", "a DOUBLE, b DOUBLE", "BOOLEAN", "coalesce(abs(a - b) < 0.01D AND NOT isnan(a) AND NOT isnan(b), false)"),
    ("money_source_price", "price DOUBLE, multiplier DOUBLE", "DOUBLE", "CASE WHEN multiplier > 0 THEN round(price / multiplier, 4) END"),
    ("money_rounded", "p DOUBLE, rounding STRING", "DOUBLE", "CASE rounding WHEN '.99' THEN floor(p) + 0.99D WHEN '.00' THEN double(floor(p + 0.5D)) ELSE p END"),
    ("money_raised", "p DOUBLE, least DOUBLE", "DOUBLE", "CASE WHEN least <> 0 AND p < least THEN least ELSE p END"),
    ("money_capped", "p DOUBLE, most DOUBLE", "DOUBLE", "CASE WHEN most <> 0 AND p > most THEN most ELSE p END"),
    (
        "money_by_rule", "base DOUBLE, multiplier DOUBLE, fixed DOUBLE, percent DOUBLE, rounding STRING, least DOUBLE, most DOUBLE", "DOUBLE",
        "round(money_capped(money_raised(money_rounded(base * multiplier + fixed + base * percent / 100, rounding), least), most), 2)",
    ),
    (
        "row_fingerprint", "url STRING, price DOUBLE, multiplier DOUBLE, collection STRING, sku STRING", "STRING",
        "sha1(concat_ws('|', url, CASE WHEN price IS NULL THEN '' ELSE format_string('%.2f', price) END, CASE WHEN multiplier IS NULL THEN '' ELSE format_string('%.4f', multiplier) END, text_label(collection), upper(trim(coalesce(sku, '')))))",
    ),
    ("cycle_start", "at TIMESTAMP, day INT", "TIMESTAMP", "timestamp(CASE WHEN date(at) >= date_add(trunc(at, 'MM'), least(28, greatest(1, day)) - 1) THEN date_add(trunc(at, 'MM'), least(28, greatest(1, day)) - 1) ELSE add_months(date_add(trunc(at, 'MM'), least(28, greatest(1, day)) - 1), -1) END)"),
)

_TEXT = T.StringType()
_VARIANT = T.StructType().add("title", _TEXT).add("sku", _TEXT).add("price", _TEXT).add("available", T.BooleanType())
_PRODUCT = T.StructType().add("pos", T.IntegerType())
for _name in ("title", "sku", "brand", "description", "raw_price", "currency"):
    _PRODUCT = _PRODUCT.add(_name, _TEXT)
_PRODUCT = _PRODUCT.add("in_stock", T.BooleanType()).add("images", T.ArrayType(_TEXT)).add("variants", T.ArrayType(_VARIANT))


def _products(found):
    for i, c in enumerate(found):
        yield (i, *(c[f.name] for f in _PRODUCT.fields[1:]))


@F.udtf(returnType=_PRODUCT)
class JsonLdProducts:
    """jsonld_products(html): the products and groups that a page's JSON-LD names, in order."""

    def eval(self, html: str):
        yield from _products(extraction.json_ld(extraction.Page(html or "")))


@F.udtf(returnType=_PRODUCT)
class EmbeddedProducts:
    """embedded_products(html): product-like nodes of the state that a page's scripts carry."""

    def eval(self, html: str):
        yield from _products(extraction.embedded(extraction.Page(html or "")))


def register(spark: SparkSession) -> None:
    """All names, for this session: scalar functions, and parse_csv_rows, page_candidates, jsonld_products, embedded_products."""
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    sheets.register(spark)
    for name, table in (("page_candidates", extraction.PageCandidates), ("jsonld_products", JsonLdProducts), ("embedded_products", EmbeddedProducts)):
        spark.udtf.register(name, table)
