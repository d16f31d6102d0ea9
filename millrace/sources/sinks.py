"""Writes as functions of frames: the new table is returned, the caller writes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], stamp: Column | None = None, stamped: str = "updated_at") -> DataFrame:
    """table with rows in place of those of their keys and the others added; stamped columns get the stamp."""
    fresh = rows if stamp is None else rows.withColumn(stamped, stamp)
    return table.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def seed(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Only where the table has no row yet are rows seeded; on conflict columns in `keep` stay unless null."""
    other = [c for c in table.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in other], F.lit(True).alias("_new"))
    both = table.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    pick = lambda c: F.coalesce(c, f"_{c}") if c in keep else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*keys, *[pick(c).alias(c) for c in other])


def updated_from(table: DataFrame, other: DataFrame, keys: list[str], sets: dict[str, Column], where: Column) -> DataFrame:
    """UPDATE ... FROM: rows whose key `other` has, and for which `where` holds, get the new values."""
    both = table.join(other.withColumn("_hit", F.lit(True)).dropDuplicates(keys), keys, "left")
    hit = F.coalesce(F.col("_hit") & where, F.lit(False))
    return both.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns])


def guarded_update(table: DataFrame, where: Column, sets: dict[str, Column], expected: int) -> DataFrame:
    """A conditional update that must touch as many rows as expected."""
    n = table.where(where).count()
    if n != expected:
        raise ValueError(f"{n} rows would change, {expected} were expected")
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in sets.items()})


def without_unseen(table: DataFrame, scan_started: Column, seen: str = "last_seen_at") -> DataFrame:
    """Rows that the scan has seen."""
    return table.where(F.col(seen) >= scan_started)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str], nulled: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """tables without the rows of the keys that are gone; in `nulled` ones the reference is emptied instead.

    gone has one column; keys names each table's reference to it.
    """
    (key,) = gone.columns
    out = {}
    for name, df in tables.items():
        ref = keys[name]
        bad = gone.distinct().withColumnRenamed(key, ref)
        if name in nulled:
            out[name] = df.join(bad.withColumn("_gone", F.lit(True)), ref, "left").withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).select(df.columns)
        else:
            out[name] = df.join(bad, ref, "left_anti")
    return out


def verified_override(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a row is after an update: a verified override keeps status and method unless the new row is active or linked by the database."""
    n = new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c != key})
    both = old.join(n, key)
    trusted = F.col("_match_status").isin("active", "linked") & (F.col("_match_method") == "database")
    hold = F.coalesce("verified_override", F.lit(False)) & ~F.coalesce(trusted, F.lit(False))
    pick = lambda c: F.when(hold, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select(key, pick("match_status"), pick("match_method"), hold.alias("verified_override"))


def run_summary(results: DataFrame, run_id: str) -> DataFrame:
    """One row: totals of a run and its status."""
    count = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    one = results.agg(F.count("*").alias("rows"), count("imported"), count("failed"), count("skipped"))
    status = F.when(F.col("rows") == 0, "empty").when(F.col("failed") == 0, "completed").when(F.col("imported") == 0, "failed").otherwise("partial")
    return one.select(F.lit(run_id).alias("run_id"), status.alias("status"), F.to_json(F.struct("rows", "imported", "failed", "skipped")).alias("details"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
