"""Values somewhere inside JSON records: records are walked level by level, as rows that know their place.

A place is the steps that lead to a value, as numbers that grow with the order in which steps are tried. Places are
compared like words, one that another begins with before it, so the value that a search in order would find first is the
one with the least place, and nothing has to be searched one by one. Each level is an explode; only what is found is
shuffled, by the record's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import clean

# The names under which records keep their stock, in order of precedence, and the parts of a record that are
# looked into before any other.
QUANTITY_KEYS = ("stockQuantity", "availableQuantity", "inventoryQuantity", "onlineStockAvailable", "quantity", "qty", "stock")
CONTAINERS = ("inventoryInfo", "availability", "raw", "product", "stockInfo")
# The names under which records describe a product, in the order in which their texts are taken.
DESCRIPTION_KEYS = (
    "description", "shortDescription", "longDescription", "details", "productDetails", "bullets", "features", "benefits", "composition", "materials", "care", "careInstructions", "highlights",
)
#: Levels below a record that are looked at; of these, levels whose values all are, whatever their names.
DEEPEST, OPEN = 4, 2
#: Steps by position come after those by name.
BY_POSITION = 100


def roots(records: DataFrame, key: str, record: Column) -> DataFrame:
    """key, kind, text, place of each record: kind as schema_of_variant says it (null for no JSON), text a string itself, or JSON."""
    json = F.try_parse_json(record)
    kind = F.schema_of_variant(json)
    text = F.when(kind == "STRING", F.try_variant_get(json, "$", "string")).otherwise(record)
    return records.select(F.col(key).alias("key"), kind.alias("kind"), text.alias("text"), F.array().cast("array<int>").alias("place"))


def inside(level: DataFrame) -> DataFrame:
    """level's objects and arrays with each value that they hold as name, position, kind and text; the rest as up_*."""
    held = level.where(F.col("kind").rlike("^(OBJECT|ARRAY)")).withColumnsRenamed({"kind": "up_kind", "text": "up_text", "place": "up_place"})
    own = F.col("up_text")
    names, typed = F.map_entries(F.from_json(own, "map<string,string>")), F.from_json(own, "map<string,variant>")
    items, typed_items = F.from_json(own, "array<string>"), F.from_json(own, "array<variant>")
    is_object = F.col("up_kind").startswith("OBJECT")
    fields = F.transform(names, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))
    listed = F.transform(items, lambda x: F.struct(F.lit("").alias("name"), x.alias("text")))
    each = held.select("*", F.when(is_object, typed).alias("typed"), F.when(~is_object, typed_items).alias("typed_items"), F.posexplode(F.when(is_object, fields).otherwise(listed)).alias("position", "e"))
    kind = F.schema_of_variant(F.when(is_object, F.col("typed")[F.col("e.name")]).otherwise(F.get("typed_items", F.col("position"))))
    return each.select("*", F.col("e.name").alias("name"), kind.alias("kind"), F.col("e.text").alias("text")).drop("typed", "typed_items", "e", "up_text")


def _rank(names: tuple[str, ...]) -> Column:
    """The name's place in a list, from 1, or null; only names of objects have one."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("int")
    return F.when(F.col("up_kind").startswith("OBJECT") & (at > 0), at)


def _steps(each: DataFrame, *steps: Column) -> DataFrame:
    """each value with a place for every step that leads to it (null: none)."""
    return each.withColumn("step", F.explode(F.array_compact(F.array(*steps)))).withColumn("place", F.concat("up_place", F.array("step")))


def quantities(records: DataFrame, key: str, record: Column) -> DataFrame:
    """key, quantity: units on hand somewhere inside each record, null where none are.

    A number counts rounded down and as 0 at the least, a string if it has digits only, with or without decimals. Of a value
    its own names are tried first, then its containers, then, near the top, all that it holds.
    """
    nested = F.col("kind").rlike("^(OBJECT|ARRAY)")
    number = F.when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.greatest(F.lit(0), F.floor(F.col("text").try_cast("double"))))
    digits = F.when((F.col("kind") == "STRING") & F.trim("text").rlike(r"^\d+(\.\d+)?$"), F.floor(F.trim("text").try_cast("double")))
    level = roots(records, key, record)
    found = [level.select("key", "place", F.lit(None).cast("bigint").alias("units"))]
    for depth in range(DEEPEST + 1):
        each = inside(level)
        found.append(_steps(each, _rank(QUANTITY_KEYS)).select("key", "place", F.coalesce(number, digits).alias("units")))
        by_position = [F.col("position") + BY_POSITION] if depth < OPEN else []
        level = _steps(each.where(nested), _rank(CONTAINERS) + len(QUANTITY_KEYS), *by_position).select("key", "kind", "text", "place")
    units = F.when(F.col("units").isNotNull(), F.struct("place", "units"))
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min(units)["units"].cast("int").alias("quantity")).withColumnRenamed("key", key)


def texts(records: DataFrame, key: str, record: Column) -> DataFrame:
    """key, texts: the pieces of text that describe the product of each record, in order.

    Strings are cut at line ends, bullets, semicolons and bars. Of an object its describing names are read in their order;
    near the top, where they give nothing, all that it holds.
    """
    level = roots(records, key, record).withColumns({"by_name_0": F.lit(True), "by_name_1": F.lit(True)})
    found = []
    for depth in range(DEEPEST + 1):
        found.append(level.where("kind = 'STRING'"))
        named = _rank(DESCRIPTION_KEYS)
        listed = F.when(F.col("up_kind").startswith("ARRAY"), F.col("position") + BY_POSITION)
        all_ = F.when(F.col("up_kind").startswith("OBJECT"), F.col("position") + BY_POSITION) if depth < OPEN else F.lit(None).cast("int")
        level = _steps(inside(level), named, listed, all_)
        if depth < OPEN:
            level = level.withColumn(f"by_name_{depth}", F.col("up_kind").startswith("ARRAY") | (F.col("step") < BY_POSITION))
        level = level.select("key", "kind", "text", "place", "by_name_0", "by_name_1")
    pieces = F.filter(F.transform(F.split("text", r"\r?\n|•|;|\|"), clean), lambda x: x != "")
    leaves = reduce(DataFrame.unionByName, found).withColumn("pieces", pieces).where(F.size("pieces") > 0)
    for depth in (1, 0):  # an object's describing names count alone where they give anything
        own = W.Window.partitionBy("key", F.slice("place", 1, depth))
        leaves = leaves.withColumn("any", F.max(f"by_name_{depth}").over(own)).where(F.col(f"by_name_{depth}") | ~F.col("any")).drop("any")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "pieces"))), lambda x: x["pieces"]))
    return leaves.groupBy("key").agg(F.array_distinct(listed).alias("texts")).withColumnRenamed("key", key)


def enriched(records: DataFrame, key: str, description: Column, record: Column, least: int = 180, alone: int = 20, most: int = 24) -> DataFrame:
    """key, description: a long one as it is, a short one with the record's further texts, one a line, or those where there is none."""
    base, own = F.col("base"), F.col("own")
    each = records.select(key, clean(description).alias("base")).join(texts(records, key, record), key, "left")
    each = each.withColumn("own", F.coalesce(F.filter("texts", lambda x: F.length(x) >= 3), F.array().cast("array<string>")))
    full = F.array_join(F.slice(F.array_distinct(F.concat(F.array(base), own)), 1, most), "\n")
    made = F.when((F.size(own) == 0) | (F.length(base) >= least), F.nullif(base, F.lit(""))).when(base == "", F.array_join(F.slice(own, 1, alone), "\n")).otherwise(full)
    return each.select(key, made.alias("description"))
