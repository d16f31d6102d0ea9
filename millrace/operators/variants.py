"""Variants of products: dedup by any of three keys, match tiers, structure checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import label


def dedupe_in_row(variants: Column) -> Column:
    """An array of structs (signature, sku, source_id, ...) without those that share a key with one kept before.

    An empty sku or source_id is no key. Sequential: a variant that is dropped marks nothing as seen.
    """
    seen = lambda keys, k: (k != "") & F.array_contains(keys, k)
    none = F.array().cast("array<string>")

    def step(acc: Column, v: Column) -> Column:
        signature, sku, source = label(v["signature"]), label(v["sku"]), label(v["source_id"])
        again = F.array_contains(acc["signatures"], signature) | seen(acc["skus"], sku) | seen(acc["sources"], source)
        keep = lambda have, k: F.when(again, have).otherwise(F.concat(have, F.array(k)))
        return F.struct(
            keep(acc["signatures"], signature).alias("signatures"),
            keep(acc["skus"], sku).alias("skus"),
            keep(acc["sources"], source).alias("sources"),
            F.concat(acc["kept"], F.array(~again)).alias("kept"),
        )

    start = F.struct(none.alias("signatures"), none.alias("skus"), none.alias("sources"), F.array().cast("array<boolean>").alias("kept"))
    kept = F.aggregate(variants, start, step, lambda acc: acc["kept"])
    return F.filter(variants, lambda v, i: F.get(kept, i))


def dedupe_rows(rows: DataFrame, product: str, order: str, keys: list[str]) -> DataFrame:
    """rows without those that share any key with an earlier kept row of their product.

    Rows are dealt out by product, sorted, and read through batch by batch: of a product of any size a task holds the
    keys of its kept rows, never the rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen = None, [set() for _ in keys]
        for frame in frames:
            keep = []
            for own, *values in frame[[product, *keys]].itertuples(index=False):
                if own != current:
                    current, seen = own, [set() for _ in keys]
                fine = not any(v and v in s for v, s in zip(values, seen, strict=True))
                keep.append(fine)
                if fine:
                    for v, s in zip(values, seen, strict=True):
                        s.add(v)
            yield frame[keep]

    return rows.repartition(product).sortWithinPartitions(product, order).mapInPandas(run, rows.schema)


def matched(fresh: DataFrame, stored: DataFrame, product: str) -> DataFrame:
    """fresh (product, idx, keys array) with the stored index of its first key that a stored variant has, else the same index.

    Keys are tried in their order; of several stored variants with a key the first counts.
    """
    key = stored.select(product, F.explode("keys").alias("key"), F.col("idx").alias("stored")).groupBy(product, "key").agg(F.min("stored").alias("stored"))
    tried = fresh.select(product, "idx", F.posexplode("keys").alias("tier", "key")).join(key, [product, "key"])
    hit = tried.groupBy(product, "idx").agg(F.min(F.struct("tier", "stored")).alias("hit")).select(product, "idx", "hit.tier", "hit.stored")
    same = stored.select(product, "idx", F.col("idx").alias("same"))
    out = fresh.join(hit, [product, "idx"], "left").join(same, [product, "idx"], "left")
    return out.select(product, "idx", F.coalesce("stored", "same").alias("stored"), F.when(F.col("stored").isNotNull(), F.col("tier")).alias("tier"))


def strictly_matched(fresh: DataFrame, stored: DataFrame, product: str) -> DataFrame:
    """Each stored variant's fresh one if exactly one shares a key with it, or if the product has only one fresh."""
    pairs = stored.select(product, F.col("idx").alias("stored"), F.explode("keys").alias("key")).join(fresh.select(product, "idx", F.explode("keys").alias("key")), [product, "key"]).select(product, "stored", "idx").distinct()
    one = pairs.groupBy(product, "stored").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n = 1").drop("n")
    only = fresh.groupBy(product).agg(F.count("*").alias("n"), F.min("idx").alias("only")).where("n = 1").drop("n")
    return stored.select(product, F.col("idx").alias("stored")).join(one, [product, "stored"], "left").join(only, product, "left").select(product, "stored", F.coalesce("idx", "only").alias("idx"))


def product_sets(columns: dict[str, Column]) -> Column:
    """array<map>: the cross product of arrays of option values, by name."""
    out = F.array(F.create_map().cast("map<string,string>"))

    def times(sets: Column, name: str, values: Column) -> Column:
        return F.flatten(F.transform(sets, lambda m: F.transform(values, lambda v: F.map_concat(m, F.create_map(F.lit(name), v)))))

    for name, values in columns.items():
        out = times(out, name, values)
    return out


def image_for_color(images: Column, color: Column) -> Column:
    """URL of the first image of a colour, or whose text names it as a word; null for none."""
    from ..functions.text import contains_label

    fits = F.filter(images, lambda i: ((label(i["color"]) == label(color)) & (label(color) != "")) | contains_label(i["alt"], color))
    return F.try_element_at(fits, F.lit(1))["url"]


def preferred(values: Column, fits) -> Column:
    """The elements that fit, or all where none does."""
    some = F.filter(values, fits)
    return F.when(F.size(some) > 0, some).otherwise(values)


def canonical(variants: DataFrame, product: str, rank: str, idx: str) -> DataFrame:
    """variants with canonical: the least rank, then index, of its product."""
    return variants.withColumn("canonical", F.row_number().over(W.Window.partitionBy(product).orderBy(rank, idx)) == 1)
