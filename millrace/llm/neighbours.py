"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised on its own; a cell of the index is a pair of centroids. A
query takes cells by the summed distance of their two centroids, one by one from a heap, until the cells taken hold
the wanted share of all entries, and their entries are reranked by exact inner products. The share is calibrated: on
a bounded sample that the centroids were not fitted to, it is the least one that finds the wanted part of the true
neighbours, so data with clusters need few entries and data without them many.

Cells are stored in groups of near first halves, cut into blocks. A query goes once, with the summed distance at
which its heap ended, to each group that has cells within it, where it meets the entries of those cells alone; no
task holds more than a block of entries and one of queries, however full a cell is. The driver sees the cells' sizes
and the sample, nothing else about the entries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import small_batches, table, written

TOP, QUERY_EVERY = 20, 20
#: Vectors drawn by hash to fit and to calibrate; rounds of k-means; queries of the calibration; centroids of a half at most.
SAMPLE, FIT_ROUNDS, CALIBRATION, MOST_CENTROIDS = 20_000, 12, 256, 1024
#: Part of the true neighbours that the share of entries read has to find on the sample.
RECALL = 0.95
#: Entries and queries of a task, and those queries that it scores at once.
ENTRIES, QUERIES, AT_ONCE = 16_384, 8_192, 512
#: Products summed in another order differ by less than this part of the vectors' lengths.
NEAR = 1e-9


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (floats or doubles) of rows that can be searched: key and vector not null, not zero, of finite components.

    Vectors of different lengths are compared as if the shorter ended in zeros.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if element in ("float", "double") else F.transform(vector, lambda x: x.cast("double"))
    fine = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return fine.where((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def n_centroids(total: int) -> int:
    """Centroids of a half: a power of two near total ** 0.45, so that cells stay about as many as entries."""
    return min(MOST_CENTROIDS, 1 << max(2, round(0.45 * math.log2(max(total, 1)))))


def centroids_of(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """k-means by Lloyd's rounds from a drawn start; fewer centroids where there are fewer distinct vectors."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = distance(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances [x, c]."""
    return (c * c).sum(axis=1) - 2 * x @ c.T + (x * x).sum(axis=1)[:, None]


class Index:
    """The two halves' centroids."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS):
        half = sample.shape[1] // 2
        self.halves = (slice(0, half), slice(half, None))
        self.centroids = [centroids_of(sample[:, h], k, rounds) if h.stop != 0 else np.zeros((1, 0)) for h in self.halves]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.centroids[0]), len(self.centroids[1])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [distance(x[:, h], c) for h, c in zip(self.halves, self.centroids, strict=True)]

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half."""
        a, b = (d.argmin(axis=1) for d in self.distances(x))
        return a, b

    def radius(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> float:
        """The summed distance of the cell with which the cells taken hold `wanted` entries; a, b: distances of a query."""
        first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        near, far, size = a[first].tolist(), b[second].tolist(), sizes[np.ix_(first, second)].tolist()
        # a row's next cell enters when its last one leaves, and the next row when the first cell of this one does
        heap, held, reached = [(near[0] + far[0], 0, 0)], 0, 0.0
        while heap and held < wanted:
            reached, i, j = heapq.heappop(heap)
            held += size[i][j]
            if j == 0 and i + 1 < len(near):
                heapq.heappush(heap, (near[i + 1] + far[0], i + 1, 0))
            if j + 1 < len(far):
                heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
        return reached

    def groups(self, sizes: np.ndarray, entries: int) -> np.ndarray:
        """A group for each centroid of the first half: near ones together, about so many as there are blocks of entries."""
        n = min(self.shape[0], max(1, -(-int(sizes.sum()) // entries)))
        return distance(self.centroids[0], centroids_of(self.centroids[0], n, FIT_ROUNDS)).argmin(axis=1)


def calibrated(index: Index, held_out: np.ndarray, longest: float, total: int, top: int, recall: float) -> float:
    """The share of entries, nearest cells first, that holds the wanted part of the true neighbours of held-out vectors.

    Their nearest neighbours among `total` are, by inner product, as far out as the nearest top * n / total among the
    n that are held out.
    """
    n = len(held_out)
    if n < 2:
        return 1.0
    x, rank = held_out, min(n - 1, max(1, round(top * n / total)))
    asked = np.arange(min(n, CALIBRATION))
    s = x[asked] @ x.T
    s[asked, asked] = -np.inf
    true = np.argpartition(-s, rank - 1, axis=1)[:, :rank]
    a, b = index.places(lifted(x, longest))
    da, db = index.distances(asking(x[asked]))
    far = da[:, a] + db[:, b]
    order = np.sort(far, axis=1)
    read = [np.searchsorted(o, f[t], "right") / n for o, f, t in zip(order, far, true, strict=True)]
    return float(np.quantile(np.concatenate(read), recall))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with a last component that brings all to one length, so that the nearest have the largest inner products."""
    return np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(axis=1)))[:, None]])


def asking(x: np.ndarray) -> np.ndarray:
    """Queries beside lifted entries."""
    return np.hstack([x, np.zeros((len(x), 1))])


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    size = np.array(column.value_lengths().to_pylist(), np.int64)
    out = np.zeros((len(column), width))
    start = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(start, size)] = flat
    return out


def exact(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in order of the components, so that equal vectors tie."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * e[:, i]
    return out


def nearest(vectors: DataFrame, is_query, top: int = TOP, recall: float = RECALL, share: float | None = None, k: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` candidates with the largest inner products for every query row.

    is_query is a condition on vec_id. Every row but the query's own is a candidate, also rows that repeat a vec_id or
    a vector; equal scores go to the smaller vec_id. Unusable vectors (see usable) take no part. share: of the entries
    that a query's cells hold, calibrated for the wanted recall unless given; k: centroids of a half.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("longest")).first()
    total, width, longest = about["n"], about["width"], about["longest"]
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    draw = rows.select("v", F.xxhash64(F.lit("fit"), "row").alias("draw")).where(F.pmod("draw", F.lit(total)) < 2 * SAMPLE)
    sample = matrix(draw.orderBy("draw").limit(SAMPLE).select("v").toArrow().column("v"), width)
    fit, held_out = sample[::2], sample[1::2]
    plan = Index(lifted(fit, longest), k or n_centroids(total))
    if share is None:
        share = calibrated(plan, held_out, longest, total, top, recall)
    index = spark.sparkContext.broadcast(plan)

    # of rows with one vector only the first top + 1 by key can be among any query's nearest
    same = W.Window.partitionBy("v").orderBy("vec_id", "row")
    first = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= top + 1).drop("copy")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, z = index.value.places(lifted(matrix(b.column("v"), width), longest))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a, pa.int32()), pa.array(z, pa.int32())], [*b.schema.names, "a", "b"])

    kind = rows.schema["v"].dataType.simpleString()
    entries = written(first.select("row", "vec_id", "v").mapInArrow(enter, f"row bigint, vec_id bigint, v {kind}, a int, b int"), "entries")
    sizes = np.zeros(plan.shape, np.int64)
    cells = entries.groupBy("a", "b").agg(F.count("*").alias("n")).toArrow()  # a number for each cell
    sizes[cells.column("a").to_numpy(), cells.column("b").to_numpy()] = cells.column("n").to_numpy()
    group_of = plan.groups(sizes, ENTRIES)
    n_groups = int(group_of.max()) + 1
    wanted = min(int(sizes.sum()), max(math.ceil(share * int(sizes.sum())), 10 * top + 1))
    members = [np.flatnonzero(group_of == g) for g in range(n_groups)]
    taken = spark.sparkContext.broadcast(sizes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                da, db = index.value.distances(asking(matrix(b.column("v"), width)))
                radius = np.array([index.value.radius(p, q, taken.value, wanted) for p, q in zip(da, db, strict=True)])
                reach = radius - db.min(axis=1)
                meets = np.stack([da[:, m].min(axis=1) <= reach if len(m) else np.zeros(len(da), bool) for m in members], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(radius), pa.array([np.flatnonzero(x).tolist() for x in meets], pa.list_(pa.int32()))], [*b.schema.names, "radius", "groups"])

    queries = rows.where(is_query(F.col("vec_id"))).select("row", "vec_id", "v").mapInArrow(look, f"row bigint, vec_id bigint, v {kind}, radius double, groups array<int>")
    queries = written(queries.withColumn("group", F.explode("groups")).drop("groups"), "queries")
    asked = {r["group"]: r["n"] for r in queries.groupBy("group").agg(F.count("*").alias("n")).collect()}  # at most a row a group
    blocks = [max(1, -(-int(sizes[m].sum()) // ENTRIES)) for m in members]
    sides = [max(1, -(-asked.get(g, 0) // QUERIES)) for g in range(n_groups)]
    of = lambda numbers, g: F.array(*map(F.lit, numbers))[g]
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    g = F.col("group")
    left = queries.withColumn("side", deal(of(sides, g), "q")).withColumn("block", upto(of(blocks, g)))
    right = entries.withColumn("group", of(group_of.tolist(), F.col("a"))).withColumn("block", deal(of(blocks, g), "e")).withColumn("side", upto(of(sides, g)))
    return reranked(left, right, index, width, top)


def reranked(left: DataFrame, right: DataFrame, index, width: int, top: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best entries among the tasks (group, block, side) that have both."""
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by("a")
        e, b = matrix(held.column("v"), width), held.column("b").to_numpy()
        row, key = held.column("row").to_numpy(), held.column("vec_id").to_numpy()
        cut = np.flatnonzero(np.diff(held.column("a").to_numpy(), prepend=-1, append=1 << 30))
        a_of = held.column("a").to_numpy()[cut[:-1]]
        q_all, own, who = matrix(asked.column("v"), width), asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        radius = asked.column("radius").to_numpy()
        out = []
        for lo in range(0, len(q_all), AT_ONCE):
            q, near = q_all[lo : lo + AT_ONCE], radius[lo : lo + AT_ONCE, None]
            da, db = index.value.distances(asking(q))
            least = db.min(axis=1)
            s = np.full((len(q), len(e)), -np.inf)
            for a, start, end in zip(a_of, cut[:-1], cut[1:], strict=True):  # the entries of a first half's cells
                some = np.flatnonzero(da[:, a] + least <= near[:, 0])
                if len(some):
                    met = da[some, a][:, None] + db[np.ix_(some, b[start:end])] <= near[some]
                    s[some, start:end] = np.where(met, q[some] @ e[start:end].T, -np.inf)
            s[own[lo : lo + AT_ONCE, None] == row[None, :]] = -np.inf
            n = min(top, len(e))
            least_kept = np.partition(s, len(e) - n, axis=1)[:, len(e) - n]
            room = NEAR * np.sqrt((q * q).sum(axis=1) * (e * e).sum(axis=1).max())
            i, j = np.nonzero((s > -np.inf) & (s >= (least_kept - room)[:, None]))
            value = exact(q[i], e[j])
            order = np.lexsort((row[j], key[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, value = i[place < top], j[place < top], value[place < top]
            out.append(pa.Table.from_arrays([pa.array(own[lo + i]), pa.array(who[lo + i]), pa.array(row[j]), pa.array(key[j]), pa.array(value)], schema=schema))
        return pa.concat_tables(out)

    keys = ["group", "block", "side"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query bigint, query_id bigint, row bigint, vec_id bigint, score double")
    order = W.Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda k: k % QUERY_EVERY == 0)
