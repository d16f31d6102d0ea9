"""Choice of pricing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rules without a supplier, and foreign ones, that differ in currency or default: counted, and broadcast up to so many.
BROADCAST_ROWS = 10_000


def _norm(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def scored(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Every item's contexts with the rules that can be its best, and their fit: eligible and score.

    items: supplier_id, currency; rules: rule_pos, supplier_id, currency, is_default and what else they carry. Contexts
    are made distinct. A supplier's own rules meet its contexts by equality. Of the others the score hangs on currency
    and default alone, so the first rule of each such kind stands for all of it (two of different suppliers where they
    have one, as a context's own does not count as foreign): only those few meet every context.
    """
    kind = ["_currency", "_default"]
    r = rules.withColumns({"_currency": _norm(F.col("currency")), "_default": F.coalesce("is_default", F.lit(False))}).withColumnsRenamed({"supplier_id": "rule_supplier", "currency": "rule_currency"})
    # the first rule of each supplier (or none), currency and default: one aggregate that all three kinds are read from
    each = r.groupBy("rule_supplier", *kind).agg(F.min_by(F.struct(*[c for c in r.columns if c not in ("rule_supplier", *kind)]), "rule_pos").alias("_first"))
    owned = each.where("rule_supplier is not null").select("rule_supplier", *kind, "_first.*")
    general = each.where("rule_supplier is null").select("rule_supplier", *kind, "_first.*")
    foreign = owned.withColumn("_n", F.row_number().over(W.Window.partitionBy(*kind).orderBy("rule_pos"))).where("_n <= 2").drop("_n")
    few = general.unionByName(foreign)
    few = F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few
    item = items.select("supplier_id", "currency").distinct()
    own = item.join(owned, F.col("supplier_id") == F.col("rule_supplier"))
    other = item.join(few, ~F.coalesce(F.col("supplier_id") == F.col("rule_supplier"), F.lit(False)))
    met = own.unionByName(other)
    currency, has, wants = _norm(F.col("currency")), F.col("_currency"), F.col("rule_supplier")
    supplier = F.coalesce(wants == F.col("supplier_id"), F.lit(False))
    fits = (wants.isNull() | supplier) & ((has == "") | (currency == "") | (has == currency))
    score = F.when(supplier, 100).when(wants.isNull(), 10).otherwise(-100) + F.when((currency != "") & (has == currency), 30).when(has == "", 5).otherwise(-20) + F.when(F.col("_default"), 15).otherwise(0)
    return met.withColumn("eligible", fits).withColumn("score", score).drop(*kind)


def best(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct context with its best rule: eligible rules before others, then score, then position."""
    context = W.Window.partitionBy("supplier_id", "currency").orderBy(F.desc("eligible"), F.desc("score"), "rule_pos")
    return scored(items, rules).withColumn("_r", F.row_number().over(context)).where("_r = 1").drop("_r")
