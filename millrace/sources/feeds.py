"""Product feeds as candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.text import clean

#: Names of each field in feeds, the first that is not empty counts.
FIELDS = {
    "url": ("url", "link"),
    "title": ("title", "name", "product_name"),
    "sku": ("sku", "id", "product_id"),
    "brand": ("brand", "vendor"),
    "description": ("description",),
    "raw_price": ("price", "sale_price", "amount", "g:price"),
    "currency": ("currency",),
    "image": ("image", "image_link", "g:image_link"),
}
XML_FIELDS = {
    "title": ("title", "name", "g:title"),
    "description": ("description",),
    "raw_price": ("price", "g:price"),
    "currency": ("currency", "g:currency"),
    "image": ("image_link", "g:image_link", "image"),
    "url": ("link", "url"),
    "sku": ("sku", "id", "g:id"),
    "brand": ("brand", "g:brand"),
}


def _first(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(clean(v), F.lit("")) for v in values], F.lit(""))


def candidates(records: DataFrame, field, keep: list[str], fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """Candidates of records; field(name) is the column with a record's field. Rows without title and SKU go."""
    each = records.select(*keep, *[_first([field(n) for n in names]).alias(k) for k, names in fields.items()])
    priced = each.withColumn("price", money.localized_number(F.col("raw_price"))).withColumn("currency", F.coalesce(F.nullif("currency", F.lit("")), money.currency(F.col("raw_price"))))
    return priced.where("title <> '' or sku <> ''")


def json_feed(files: DataFrame, text: str = "text") -> DataFrame:
    """Records of JSON feeds: an array at the top, or under products, items or data."""
    keep = [c for c in files.columns if c != text]
    v = F.try_parse_json(text)
    listed = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.products", "$.items", "$.data")])
    each = files.select(*keep, F.posexplode(listed).alias("pos", "record"))
    return candidates(each, lambda n: F.try_variant_get("record", f"$['{n}']", "string"), [*keep, "pos"])


def xml_feed(files: DataFrame, text: str = "text") -> DataFrame:
    """Records of XML feeds by pattern, so that ill-formed ones are read too."""
    keep = [c for c in files.columns if c != text]
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<(?:item|product)\b.*?</(?:item|product)>"), F.lit(0))
    each = files.select(*keep, F.posexplode(blocks).alias("pos", "xml"))
    tag = lambda n: F.regexp_replace(F.regexp_extract("xml", rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"<!\[CDATA\[|\]\]>", "")
    return candidates(each, tag, [*keep, "pos"], XML_FIELDS)


def csv_feed(matrix: DataFrame, keep: list[str]) -> DataFrame:
    """Records of CSV feeds (file columns, row_index, cells): the first row names the fields."""
    head = matrix.where("row_index = 0").select(*keep, F.transform("cells", lambda c: F.trim(c)).alias("names"))
    each = matrix.where("row_index > 0").join(head, keep).withColumn("record", F.map_from_arrays(F.array_distinct("names"), F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size(F.array_distinct("names")))))
    return candidates(each.withColumn("pos", F.col("row_index") - 1), lambda n: F.try_element_at("record", F.lit(n)), [*keep, "pos"])


