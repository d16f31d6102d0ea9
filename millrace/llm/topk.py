"""Exact top-k search by inner products of whole numbers, in three phases with one uniform threshold.

The components are cut into lists: each list scores every entry by its own components only, and a score is the sum of
an entry's scores in all lists. A node is a list's block of entries; no node sees another list.

1. Every node sends the k + 1 highest entries of its list for each query. Those that any node named are scored in
   full, as products have either sign and a missing list bounds nothing from below; the k-th of these scores is a safe
   cutoff, since k entries reach it.
2. The cutoff goes with each query to all nodes. An entry whose score reaches it has, in some list, at least the
   cutoff's share of one list, so nodes send the entries that reach that share. What an entry has in the lists that
   sent it, with less than a share for each other list, bounds its score; entries that all lists sent are known
   exactly and raise the cutoff; what cannot reach it goes.
3. The scores of the others are resolved from the vectors. The k highest of all known ones are the answer.

All numbers are integers, so a tie at the cutoff is seen as one. Of rows with one vector only the first k + 1 by id can
be in an answer; copies beyond them are not entries, so a vector that a third of all rows share makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small, small_batches, table, written
from .vectors import EXACT, floored, grid

TOP, QUERY_EVERY, SCALE = 5, 50, 256
#: Lists that the components are cut into. With more of them a share says less: of vectors without structure, two lists
#: send a part of about sqrt(k / n) of their entries, four about its root.
LISTS = 2
#: Entries and queries of a node's task, and queries that it scores at once.
ENTRIES, QUERIES, AT_ONCE = 16_384, 8_192, 512
#: Most queries whose vectors are broadcast to the pairs to resolve (some 10 MB).
SENT = 20_000

NAMED = "query bigint, row bigint, vec_id bigint, list int, part bigint"


class Lists:
    """The nodes: every list's entries in blocks, beside every query in sides."""

    def __init__(self, entries: DataFrame, queries: DataFrame, width: int, most: int, lists: int):
        self.entries, self.queries, self.lists = entries, queries, lists
        self.step = max(1, -(-width // lists))
        self.kind = np.float64 if most * most * max(width, 1) < EXACT else np.int64
        self.blocks = max(1, -(-entries.count() // ENTRIES))
        self.sides = max(1, -(-queries.count() // QUERIES))

    def cut(self, df: DataFrame, salt: str, many: int, other: str, others: int) -> DataFrame:
        """Each row's list slices, dealt into `many` by its row and copied to all `others`."""
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = df.withColumn(salt, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(many)).cast("int")).withColumn("list", upto(self.lists)).withColumn(other, upto(others))
        return dealt.withColumn("x", F.slice("x", F.col("list") * self.step + 1, self.step))

    def ask(self, queries: DataFrame, answer) -> DataFrame:
        """What every node sends: answer(scores, cutoffs or None) gives the places (query, entry) in its list's scores."""
        step, kind, schema = self.step, self.kind, pa.schema([("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("list", pa.int32()), ("part", pa.int64())])

        def node(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return schema.empty_table()
            q, e = grid(asked.column("x"), step, kind), grid(held.column("x"), step, kind).T
            who, row, key = (t.column(c).to_numpy() for t, c in ((asked, "row"), (held, "row"), (held, "vec_id")))
            cutoff = asked.column("cutoff").to_numpy() if "cutoff" in asked.column_names else None
            out = []
            for lo in range(0, len(q), AT_ONCE):
                s = q[lo : lo + AT_ONCE] @ e
                i, j = answer(s, None if cutoff is None else cutoff[lo : lo + AT_ONCE])
                other = who[lo + i] != row[j]
                i, j = i[other], j[other]
                lists = np.full(len(i), asked.column("list")[0].as_py(), np.int32)
                out.append(pa.Table.from_arrays([pa.array(who[lo + i]), pa.array(row[j]), pa.array(key[j]), pa.array(lists), pa.array(s[i, j].astype(np.int64))], schema=schema))
            return pa.concat_tables(out)

        keys = ["list", "block", "side"]
        left, right = self.cut(queries, "side", self.sides, "block", self.blocks), self.cut(self.entries, "block", self.blocks, "side", self.sides)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(node, NAMED)

    def resolved(self, pairs: DataFrame) -> DataFrame:
        """query, row, vec_id, score of distinct pairs, from both whole vectors."""
        width = self.step * self.lists

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                score = (grid(b.column("x"), width) * grid(b.column("q"), width)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("row"), b.column("vec_id"), pa.array(score, pa.int64())], ["query", "row", "vec_id", "score"])

        asked = small(self.queries.select(F.col("row").alias("query"), F.col("x").alias("q")), SENT)
        both = pairs.select("query", "row", "vec_id").join(self.entries.select("row", "x"), "row").join(asked, "query")
        return both.mapInArrow(products, "query bigint, row bigint, vec_id bigint, score bigint")


def cutoffs(known: DataFrame, top: int) -> DataFrame:
    """query, cutoff: the top-th highest of each query's known scores; queries with fewer of them are not in it."""
    order = W.Window.partitionBy("query").orderBy(F.desc("score"))
    return known.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).where(F.col("at") == top).select("query", F.col("score").alias("cutoff"))


def highest(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n highest of every row."""
    n = min(n, s.shape[1])
    j = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.repeat(np.arange(len(s)), n), j.ravel()


def top_scores(vectors: DataFrame, is_query, top: int = TOP, scale: int = SCALE, lists: int = LISTS, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the `top` rows with the highest inner products of floor(scale * component).

    is_query is a condition on vec_id. Every row but the query's own is a candidate, also rows that repeat a vec_id or a
    vector; equal scores go to the smaller vec_id. Rows without a vec_id, with a null vector, or with a component that is
    null or not finite take no part. Zero and empty vectors do, with scores of 0; shorter vectors count as if they ended
    in zeros. Other columns may have any name. An empty table, or one without queries, gives no rows. Components so large
    that a score leaves 64 bits raise an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    named = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    found, width, most = floored(named, scale, "v", "integers")
    rows = found.select("row", "vec_id", "x")
    copies = W.Window.partitionBy("x").orderBy("vec_id", "row")
    entries = written(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= top + 1).drop("copy"), "entries")
    queries = written(rows.where(is_query(F.col("vec_id"))), "asked")
    nodes = Lists(entries, queries, width, most, lists)

    # 1: what some node names, scored in full
    named = nodes.ask(queries, lambda s, _: highest(s, top + 1)).select("query", "row", "vec_id").distinct()
    known = written(nodes.resolved(named), "known")
    cut = written(cutoffs(known, top), "cutoffs")

    # 2: the entries with a list's share of the cutoff; all of them where fewer than `top` were named
    least = F.coalesce("cutoff", F.lit(-(1 << 62)))
    asked = queries.join(small(cut.withColumnRenamed("query", "row")), "row", "left").withColumn("cutoff", least)
    sent = nodes.ask(asked, lambda s, c: np.nonzero(s * lists >= c[:, None]))
    summed = written(sent.groupBy("query", "row", "vec_id").agg(F.sum("part").alias("seen"), F.count("*").alias("lists")), "sent")
    whole = summed.where(F.col("lists") == lists).select("query", "row", "vec_id", F.col("seen").alias("score"))
    both = known.unionByName(whole).distinct()
    raised = written(cutoffs(both, top), "raised")
    share = cut.join(raised.withColumnRenamed("cutoff", "raised"), "query")
    partly = summed.where(F.col("lists") < lists).join(small(written(share, "share")), "query", "left")
    under = F.floor((F.col("cutoff") - 1) / lists)  # doubles round: one more keeps it a bound
    reach = F.col("seen") + (lists - F.col("lists")) * (under + F.lit(1))
    open_ = partly.where(F.col("raised").isNull() | (reach >= F.col("raised"))).join(known.select("query", "row"), ["query", "row"], "left_anti")

    # 3: the rest, exactly
    every = both.unionByName(nodes.resolved(open_))
    order = W.Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = small(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")))
    return best.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest whole-number scores for every embedding whose vec_id is divisible by 50."""
    return top_scores(table(spark, sf_dir, "embeddings"), lambda k: k % QUERY_EVERY == 0)


SQL = f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, e.r as er, e.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.x, e.x), lambda z: coalesce(z[1] * z[2], 0))), 0)::bigint as score
  from v as q join v as e on q.r <> e.r where q.vec_id % {QUERY_EVERY} = 0
)
select query_id, (row_number() over (partition by r order by score desc, vec_id, er))::int as rank, vec_id, score from s
qualify rank <= {TOP}
"""
