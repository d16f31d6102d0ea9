"""N-gram Jaccard join by chosen paths.

Documents with one set of word shingles are one class at once; a representative of each goes on. Sets are embedded
as in the chosen-path join for similarities: MINHASHES min-hashed tokens stand for a set, two sets agreeing at each
with probability equal to their similarity. A run splits the sets on a sampled token, splits buckets that are still
large on a further one, up to DEPTH, and compares small buckets by brute force on one byte of every token; runs
with other tokens repeat until a pair at the threshold is met with the target recall. What is met that way, with
room for the sketch's error, forms clusters; every pair inside a cluster is then checked exactly on the shingles. A
cluster of many sets is not compared all with all: its sets are split on paths again, the pairs of each small bucket
are checked exactly, and a pair counts in the first run that brings it together.

Larger buckets and clusters are dealt out as pairs of blocks, so a group of copies of any size is spread
over tasks that hold two blocks. Tasks return counts and the links of a spanning forest, never all pairs.

A class is known by the digest of its set and numbered for the joins; doc_id is data, so rows may share or lack one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small, small_batches, table, written
from .components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
MINHASHES, DEPTH = 128, 3
#: A bucket of at most so many is small; a block of sketches and one of whole sets have about so many.
SMALL, BLOCK, SET_BLOCK = 64, 1024, 512
#: A cluster of more sets is split on paths: it would be dealt out as more pairs of blocks than there are runs.
LARGE = 8 * SET_BLOCK
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 20
#: A sketch says a pair may be similar down to so many standard errors below the threshold.
ERRORS = 4.0

_rng = np.random.default_rng(20240501)
_ODD = _rng.integers(0, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, MINHASHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of a text as the bytes of its words: A-Z lower-cased, 0 where no word is.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a path of full depth with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word b[start:end], wherever it stands."""
    power = np.cumprod(np.full(len(b), _BASE))
    total = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * power)])
    back = np.cumprod(np.full(len(b) + 1, _UNBASE))
    return mixed((total[end] - total[start]) * back[start])


def shingles(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A text of fewer words than the
    width has one shingle of them all; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    b = _WORD[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    edge = np.flatnonzero(np.diff((b > 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(b), CHUNK)), len(start)))
    word = np.concatenate([hashed(b[start[lo] : end[hi - 1]], start[lo:hi] - start[lo], end[lo:hi] - start[lo]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
    first = np.searchsorted(start, at)
    out = []
    n = len(word) - width + 1
    window = sum((word[i : i + n] * _PLACE[i] for i in range(width)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
    window = mixed(window)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(window[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mixed((word[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) ^ np.uint64(hi - lo)))
        else:
            out.append(word[:0])
    return out


def embedded(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashed tokens [sets, MINHASHES] of sets that are not empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * odd + add, at) for odd, add in zip(_ODD, _ADD, strict=True)], axis=1)


def paths_of(tokens: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """Path numbers [sets, runs * depth]: a run's first token, its first two, and so on, each under its own number."""
    out = np.empty((len(tokens), runs, depth), np.uint64)
    for r in range(runs):
        path = np.full(len(tokens), r + 1, np.uint64)
        for d in range(depth):
            path = mixed(path * _BASE + mixed(tokens[:, (r * depth + d) % MINHASHES] + np.uint64(d)))
            out[:, r, d] = path
    return out.reshape(len(tokens), runs * depth).view(np.int64)


def text_key(text: str = "text") -> Column:
    """A 128-bit digest of a text; null for null."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def embeddings(docs: DataFrame, runs: int, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key, class (digest of the shingle set), sketch, paths of every row; class null where no word is."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            sets = shingles(part.column(2).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            key, sketch, paths = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                tokens = embedded([sets[i] for i in full])
                small = (mixed(tokens) >> np.uint64(56)).astype(np.uint8)
                for i, s, p in zip(full, small, paths_of(tokens, runs, depth), strict=True):
                    key[i], sketch[i], paths[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s.tobytes(), p
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "class", "sketch", "paths"],
            )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, f"doc_id {id_type}, text_key binary, class binary, sketch binary, paths array<bigint>")


def leaves(sets: DataFrame, runs: int, depth: int, most: int) -> DataFrame:
    """path, rep, n, run: the bucket that each set ends in, run by run, of those that hold n >= 2 sets."""
    run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    open_ = sets.select("rep", "paths", run.alias("run")).select("rep", "run", F.slice("paths", F.col("run") * depth + 1, depth).alias("paths"))
    out = None
    for d in range(depth):
        path = F.col("paths")[d]
        # few paths are shared: their counts go to the sets, or both are shuffled where there are too many
        n = written(open_.groupBy(path.alias("path")).agg(F.count("*").alias("n")).where("n > 1"), f"counts{d}")
        each = open_.withColumn("path", path).join(small(n), "path")
        if d + 1 < depth:
            each = written(each, f"paths{d}")
            open_ = each.where(F.col("n") > most).select("rep", "run", "paths")
            each = each.where(F.col("n") <= most)
        each = each.select("path", "rep", "n", "run")
        out = each if out is None else out.unionByName(each)
    return out


def dealt(rows: DataFrame, group: str, n: str, key: str, block: int) -> DataFrame:
    """rows with _task and _part: groups over `block` as pairs of blocks, each row in all pairs that have its block.

    _task is a digest of group and pair, _same says whether the pair is a block with itself, and _part is the
    row's side, 0 or 1, in a pair of two.
    """
    blocks = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64(key, F.lit("block")), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    out = rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_other", other)
    pair = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return out.withColumn("_task", pair).withColumn("_part", (F.col("_own") > F.col("_other")).cast("int")).withColumn("_same", F.col("_own") == F.col("_other")).drop("_own", "_other", "_blocks")


def by_task(rows: DataFrame, columns: list[str], names: list[str], work: Callable[[dict[str, list]], list[tuple]]) -> DataFrame:
    """work's rows (bigint columns of the given names) over every _task's columns, one task after the other."""

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            task = batch.column("_task").to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), batch.num_rows]
            done: list[tuple] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("_task")[0].as_py() != task[lo]:
                    done += work(_columns(held, columns))
                    held = []
                held.append(batch.slice(lo, hi - lo))
            if done:
                yield out(done)
        if held and (done := work(_columns(held, columns))):
            yield out(done)

    ready = rows.select("_task", *columns).repartition("_task").sortWithinPartitions("_task")
    return ready.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _columns(parts: list[pa.RecordBatch], names: list[str]) -> dict[str, list]:
    return {c: [x for p in parts for x in p.column(c).to_pylist()] for c in names}


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            left[i] = False
            edge = [i]
            while edge:
                new = near[edge].any(axis=0) & left
                edge = np.flatnonzero(new).tolist()
                left &= ~new
                out += [(i, j) for j in edge]
    return out


def links_of(near: np.ndarray, part: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that a task adds to its blocks' graph, near being all similar pairs among its rows.

    A block with itself adds a spanning forest. A pair of blocks adds only what joins different components of the
    two, which their own tasks have joined inside: a group of similar rows costs a pair one edge, not one a row.
    """
    if same:
        return forest(near)
    label = np.arange(len(near))
    for root, member in forest(near & (part[:, None] == part[None, :])):
        label[member] = root
    i, j = np.nonzero(near & (part[:, None] < part[None, :]))
    if not len(i):
        return []
    _, first = np.unique(label[i] * len(near) + label[j], return_index=True)
    top = list(range(len(near)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y:
            top[y] = x
            out.append((a, b))
    return out


def met_in_buckets(columns: dict[str, list]) -> list[tuple]:
    """Links between representatives of a bucket whose sketches are near enough."""
    rep = np.array(columns["rep"])
    sketch = np.frombuffer(b"".join(columns["sketch"]), np.uint8).reshape(len(rep), MINHASHES)
    part = np.array(columns["_part"])
    error = math.sqrt(THRESHOLD * (1 - THRESHOLD) / MINHASHES)
    least = MINHASHES * (THRESHOLD - ERRORS * error)
    near = np.stack([(sketch == s).sum(axis=1) >= least for s in sketch])
    return [(int(rep[i]), int(rep[j])) for i, j in links_of(near, part, columns["_same"][0])]


def exact(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric boolean matrix of pairs with Jaccard similarity of at least the threshold, without the diagonal."""
    m = len(sets)
    size = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(m), size)
    token, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    column = np.cumsum(times > 1) - 1
    owner, column = owner[shared], column[inverse[shared]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, z = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[owner[a:z], column[a:z] - lo] = 1
        both += x @ x.T
    near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(near, False)
    return near


def _counted(rep: np.ndarray, near: np.ndarray, part: np.ndarray, same: bool) -> list[tuple]:
    """(a, b, 0) for links of a spanning forest and (rep, n, 1) for a representative's number of links here."""
    links = (near if same else near & (part[:, None] != part[None, :])).sum(axis=1)
    return [(int(rep[i]), int(rep[j]), 0) for i, j in links_of(near, part, same)] + [(int(r), int(n), 1) for r, n in zip(rep, links, strict=True) if n]


def linked_in_clusters(threshold: float) -> Callable[[dict[str, list]], list[tuple]]:
    def work(columns: dict[str, list]) -> list[tuple]:
        near = exact([np.frombuffer(s, np.uint64) for s in columns["set"]], threshold)
        return _counted(np.array(columns["rep"]), near, np.array(columns["_part"]), columns["_same"][0])

    return work


def linked_in_buckets(threshold: float) -> Callable[[dict[str, list]], list[tuple]]:
    """As linked_in_clusters, for a bucket of a run: a pair that an earlier run brings together is left to that one."""

    def work(columns: dict[str, list]) -> list[tuple]:
        near = exact([np.frombuffer(s, np.uint64) for s in columns["set"]], threshold)
        ends, run = np.array(columns["ends"]), columns["run"][0]
        for r in range(run):
            near &= ends[:, None, r] != ends[None, :, r]
        return _counted(np.array(columns["rep"]), near, np.array(columns["_part"]), columns["_same"][0])

    return work


def shingle_sets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs (text and the named bigint columns) with `set`, the bytes of the shingle hashes, for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, len(keep)):
            sets = [s.tobytes() for s in shingles(part.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(sets, pa.binary())], [*keep, "set"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} bigint" for k in keep) + ", set binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, class_key, n_links, n_copies, text_key, stays for every row.

    class_key is the least digest of a set among those that links of at least the threshold lead to, and names the
    class; class_id is the least doc_id of its documents, of whatever type. n_links counts the other distinct shingle sets
    that are linked to the row's own; n_copies counts the rows with its very set. stays tells the one document (doc_id and
    digest of its text) that is kept of a class. A row without words is alone and stays, with null class_key. Rows that
    share a doc_id are told apart by their texts, rows without one join classes like all others; texts of any length
    are read whole.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"sketches are sized for thresholds of {THRESHOLD} or more")
    small_batches(docs.sparkSession)
    runs = runs_for(recall)
    rows = written(embeddings(docs, runs), "embedded")
    # a null doc_id comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    member = rows.where("class is not null").groupBy("class").agg(first, F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    sets = written(member.withColumn("rep", F.monotonically_increasing_id()), "sets")
    buckets = written(leaves(sets, runs, DEPTH, SMALL), "buckets")
    met = by_task(dealt(buckets.join(sets.select("rep", "sketch"), "rep"), "path", "n", "rep", BLOCK), ["rep", "sketch", "_part", "_same"], ["a", "b"], met_in_buckets)
    clusters = components(written(met.distinct(), "met"))
    number = clusters.groupBy("root").agg(F.count("*").alias("n"))
    cluster = written(clusters.join(number, "root").select(F.col("node").alias("rep"), "root", "n").join(sets.select("rep", "first.doc_id", "first.text_key"), "rep"), "clusters")
    same_text = docs.select("doc_id", text_key().alias("text_key"), "text").alias("d")
    few = small(cluster).alias("c")
    texts = same_text.join(few, F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.text_key") == F.col("d.text_key"))).select("rep", "root", "n", "text").dropDuplicates(["rep"])
    full = shingle_sets(texts, ["rep", "root", "n"])
    one_by_one = linked_in_clusters(threshold)
    if cluster.where(F.col("n") > LARGE).isEmpty():
        links = by_task(dealt(full, "root", "n", "rep", SET_BLOCK), ["rep", "set", "_part", "_same"], ["a", "b", "kind"], one_by_one)
    else:
        full = written(full, "full")
        split = written(split_on_paths(cluster.where(F.col("n") > LARGE), buckets), "split")
        whole = full.join(split.select("root").distinct(), "root", "left_anti")
        links = by_task(dealt(whole, "root", "n", "rep", SET_BLOCK), ["rep", "set", "_part", "_same"], ["a", "b", "kind"], one_by_one)
        links = links.unionByName(links_by_paths(full.select("rep", "set"), split, runs, threshold))
    links = written(links, "linked")
    joined = written(components(links.where("kind = 0").select("a", "b")), "joined")
    degree = links.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n_links"))
    named = joined.join(sets.select(F.col("rep").alias("node"), "class", "first"), "node")
    one = written(named.groupBy("root").agg(F.min("class").alias("root_class"), F.min("first").alias("root_first")), "classes")
    tied = joined.join(one, "root").select(F.col("node").alias("rep"), "root_class", "root_first")
    best = sets.select("class", "rep", "n_copies", "first").join(tied, "rep", "left").join(degree, "rep", "left")
    best = best.select("class", "n_copies", "n_links", F.coalesce("root_class", "class").alias("class_key"), F.coalesce("root_first", "first").alias("root_first"))
    known = F.col("class").isNotNull()
    return rows.select("doc_id", "text_key", "class").join(best, "class", "left").select(
        "doc_id",
        F.when(known, F.col("root_first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.lower(F.hex("class_key")).alias("class_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "text_key",
        (~known | F.col("root_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("root_first.text_key") == F.col("text_key"))).alias("stays"),
    )


def split_on_paths(cluster: DataFrame, buckets: DataFrame) -> DataFrame:
    """path, root, rep, run, n: the buckets that members of large clusters (rep, root, n) end in, n members to each.

    Only of clusters whose buckets have fewer pairs, over all runs, than the cluster itself: chains of sets, of which few
    are similar. A cluster of sets that are all alike has buckets like itself.
    """
    each = buckets.select("path", "rep", "run").join(cluster.select("rep", "root", F.col("n").alias("size")), "rep")
    number = each.groupBy("path", "root").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    pairs = number.groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.first("size").alias("size"))
    chains = pairs.where(F.col("pairs") < F.col("size").cast("double") * F.col("size")).select("root")
    return each.drop("size").join(number.drop("size").join(chains, "root"), ["path", "root"])


def links_by_paths(sets: DataFrame, split: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Links (see linked_in_clusters) of sets (rep, set): each goes once to each run's bucket, and learns where all runs end."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.col("_ends")[r], F.col("rep") * runs + r))
    ends = split.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("run", "path"))).alias("_ends")).select("rep", spread.alias("ends"))
    each = split.where(F.col("n") > 1).join(sets, "rep").join(ends, "rep").withColumn("bucket", F.xxhash64("path", "root"))
    columns = ["rep", "set", "ends", "run", "_part", "_same"]
    return by_task(dealt(each, "bucket", "n", "rep", SET_BLOCK), columns, ["a", "b", "kind"], linked_in_buckets(threshold))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_key", "n_links", "n_copies")


def brute_force(texts: dict[int, str | None], threshold: float = THRESHOLD) -> dict[int, tuple[int, int, int]]:
    """class_id, n_links, n_copies by comparing all pairs of word tuples, for tests."""
    import re

    from .common import WORD

    low = {65 + i: 97 + i for i in range(26)}

    def grams(t: str | None) -> frozenset:
        w = re.findall(WORD, (t or "").translate(low))
        return frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()

    sets = {k: grams(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    links: dict[int, set] = {k: set() for k in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {k: (find(k), len(links[k]), sum(sets[j] == sets[k] for j in ids) if sets[k] else 1) for k in ids}
