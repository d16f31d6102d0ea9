"""Connected components of an undirected graph by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwritten, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label, which halves long
    paths. Labels are written each round; only a count comes to the driver.
    """
    both = written(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    root = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    last = root
    for _ in range(rounds):
        seen = both.join(root.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("best"))
        near = root.join(seen, "node").select("node", "root", F.least("root", "best").alias("best"))
        above = root.select(F.col("node").alias("best"), F.col("root").alias("top"))
        new = written(near.join(above, "best", "left").select("node", F.least("best", F.coalesce("top", "best")).alias("next"), "root"), "roots")
        changed = new.where(F.col("next") != F.col("root")).limit(1).count()
        unwritten(last)
        last, root = new, new.select("node", F.col("next").alias("root"))
        if not changed:
            return root
    raise RuntimeError(f"components did not settle in {rounds} rounds")
