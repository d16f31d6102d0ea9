"""The prefix trie of conversations: sorted turn arrays, their longest common prefixes, and a stack.

A conversation is an array of turns, each a digest of 16 bytes; as one binary key, keys sort like the arrays. They are
sorted over the whole cluster by key and conv_id, so copies of one conversation are spread like any other rows. A task
sweeps its rows once: the common prefix of neighbours says how many nodes end and how many begin, nodes are the
entries of a stack, and what a node has gathered goes to the one below it when it ends. What is gathered is linear in
the rows: a row that shares its first d turns with the row before it saves those turns' characters, and a row that the
next one does not extend is a leaf. A node's saved tokens are the savings of its rows but the first, less those of the
turns above it.

A node that is a prefix of a task's first or last key may go on in the task before or after it. Such open nodes come out
as one part for each task. Two numbers for each boundary, the common prefixes across it and from the first to the last
key of a task, tell which parts belong together; the parts are then summed like any group.

A node's digest of conv_ids is read from one run of equal keys, in order. Runs that may go on elsewhere, or are long, are
sent as chunks of text, which one task reads in order without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import small, small_batches, table, written

#: Bytes of a turn's digest; turns that a conversation can have from another one, and how many share that one.
TURN, HEADS, FAMILY = 16, 6, 100
#: Characters of conv_ids that are sent as one chunk; rows that a task gathers before it passes them on; children from
#: which on a node is sent to its children instead of being met by a shuffle.
CHUNK, OUT_ROWS, MANY_CHILDREN = 1 << 16, 5_000, 1_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order as an array of struct<id, chars>.

    Turns are ordered by number, null first, then by role and digest. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    of = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    turn = F.struct("turn", role.alias("role"), F.unhex(F.substring(of, 1, 2 * TURN)).alias("id"), F.length(text).cast("long").alias("chars"))
    found = rows.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return found.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def with_heads(arrays: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """Each conversation c with the first h turns of c - c % family in place of its own, h = crc32(c) % heads."""
    c = F.col("conv_id")
    first = arrays.where(c % family == 0).select(c.alias("_base"), F.slice("turns", 1, max(1, heads - 1)).alias("_head"))
    own = arrays.withColumn("_base", c - c % family).withColumn("_h", (F.crc32(F.encode(c.cast("string"), "UTF-8")) % heads).cast("int"))
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.array().cast(arrays.schema["turns"].dataType))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.join(first, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (x.bit_length() + 7) // 8) // TURN


class Node:
    """A node whose rows are being read; id: of this task, negative on the path of the first key."""

    __slots__ = ("above", "children", "conv", "ends", "id", "leaves", "n", "saved")

    def __init__(self, id_: int, above: int, children: int):
        self.id, self.above, self.children = id_, above, children
        self.n = self.saved = self.leaves = 0
        self.conv: int | None = None
        self.ends: str | None = None


KIND = (
    "kind string, part int, id bigint, parent bigint, depth int, n bigint, conv bigint, children bigint, saved bigint, leaves bigint, above bigint, "
    "is_left boolean, is_right boolean, ends string, chunk int, first binary, last binary, own array<bigint>"
)
ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("id", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("n", "conv", "children", "saved", "leaves", "above")],
     ("is_left", pa.bool_()), ("is_right", pa.bool_()), ("ends", pa.string()), ("chunk", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("own", pa.list_(pa.int64()))]
)


class Sweep:
    """One task's pass over its sorted rows; `out` fills with rows of KIND.

    kind `node` is a whole node, `open` this task's part of one that may go on, `chunk` a piece of conv_ids of one run, and
    `edge` the task's first and last keys, with `n` the turns that these have in common and `own` the characters
    before each turn of the first. Ids count up in the task, but are -1 - depth on the path of the first key; `above` is
    the characters of all turns above a node's last.
    """

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.stack: list[Node] = []
        self.key: bytes | None = None
        self.first, self.through, self.ids = b"", 0, 0
        self.first_sums: list[int] = []
        self.run: list[str] = []
        self.held = self.chunk = 0

    def row(self, kind: str, **of) -> None:
        self.out.append({"kind": kind, "part": self.part} | of)

    def send(self) -> None:
        """Sends the run's conv_ids so far as a chunk."""
        self.row("chunk", id=self.stack[-1].id, ends=",".join(self.run), chunk=self.chunk)
        self.run, self.held, self.chunk = [], 0, self.chunk + 1

    def end_run(self, goes_on: bool) -> None:
        """The rows of the current key are over in this task."""
        if self.run:
            if goes_on or self.chunk or self.stack[-1].id == -1 - len(self.first) // TURN:
                self.send()
            else:
                self.stack[-1].ends = hashlib.sha256(",".join(self.run).encode()).hexdigest()
        self.run, self.held, self.chunk = [], 0, 0

    def close(self, is_last: bool = False) -> None:
        """The node on top is over in this task, and goes to the one below."""
        depth, node = len(self.stack) - 1, self.stack.pop()
        below = self.stack[-1] if self.stack else None
        open_ = is_last or node.id < 0
        self.row(
            "open" if open_ else "node", id=node.id, parent=None if below is None else below.id, depth=depth, n=node.n, conv=node.conv, children=node.children,
            saved=node.saved, leaves=node.leaves, above=node.above, is_left=node.id < 0, is_right=is_last, ends=node.ends,
        )
        if below is not None:
            below.n, below.saved, below.leaves = below.n + node.n, below.saved + node.saved, below.leaves + node.leaves
            below.conv = node.conv if below.conv is None else min(below.conv, node.conv)

    def add(self, key: bytes, conv: int, chars: list[int]) -> None:
        depth = len(key) // TURN
        sums = [0]
        for c in chars:
            sums.append(sums[-1] + c)
        if self.key is None:
            self.first, self.first_sums, shared = key, sums, -1
            self.through = depth
        else:
            shared = depth if key == self.key else common(key, self.key)
            self.through = min(self.through, shared)
            if key != self.key:
                self.end_run(False)
                if shared < len(self.key) // TURN:  # else this row goes on from the last one's node
                    self.stack[-1].leaves += 1
                while len(self.stack) - 1 > shared:
                    self.close()
            self.stack[-1].saved += sums[shared]
            if depth > shared:
                self.stack[-1].children += 1
        for d in range(shared + 1, depth + 1):
            if self.key is None:
                id_ = -1 - d
            else:
                id_, self.ids = self.ids, self.ids + 1
            self.stack.append(Node(id_, sums[max(d - 1, 0)], int(d < depth)))
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        self.key = key
        self.run.append(str(conv))
        self.held += len(self.run[-1]) + 1
        if self.held > CHUNK:
            self.send()

    def finish(self) -> None:
        if self.key is not None:
            self.end_run(True)
            while self.stack:
                self.close(True)
            self.row("edge", n=self.through, first=self.first, last=self.key, own=self.first_sums)


def swept(keys: DataFrame) -> DataFrame:
    """Rows of KIND from conv_id, key, chars, sorted over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sweep(TaskContext.get().partitionId())

        def out() -> pa.RecordBatch:
            rows, s.out = s.out, []
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)

        for b in batches:
            for key, conv, chars in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "chars")), strict=True):
                s.add(key, conv, chars)
                if len(s.out) >= OUT_ROWS:
                    yield out()
        s.finish()
        yield out()

    return keys.mapInArrow(run, KIND)


@F.pandas_udf(IntegerType())
def common_turns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


class Boundaries:
    """The tasks that had rows, in order: what one's last key and the next one's first have in common, and first with last."""

    def __init__(self, found: DataFrame):
        spark, edge = found.sparkSession, found.where("kind = 'edge'")
        self.through = {r["part"]: r["n"] for r in edge.select("part", "n").collect()}  # a number a task
        order = sorted(self.through)
        follows = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "before int, part int")
        left = edge.select(F.col("part").alias("before"), F.col("last"))
        both = F.broadcast(follows).join(left, "before").join(edge.select("part", "first", "own"), "part")
        across = both.withColumn("n", common_turns("last", "first")).select("part", "n", F.col("own")[F.col("n")].alias("saved"))
        self.order, self.place = order, {p: i for i, p in enumerate(order)}
        self.across, self.saved = [-1] * len(order), [0] * len(order)
        for r in across.collect():  # two numbers a task
            self.across[self.place[r["part"]]], self.saved[self.place[r["part"]]] = r["n"], r["saved"]

    def owners(self, part: int, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of these depths on the path of a task's first key: where they begin, and whether on that first key's path."""
        p = self.place[part]
        # going back from the task: across its left boundary, through the task before, across that one's boundary, ...
        steps = [self.across[p]]
        for q in range(p - 1, -1, -1):
            if steps[-1] < 0:
                break
            steps += [min(steps[-1], self.through[self.order[q]])]
            steps += [min(steps[-1], self.across[q])]
        # the first step that is too short; an even one is a boundary, so the node begins with the first key after it
        at = np.searchsorted(-np.array(steps), -depths, side="right")
        return np.array(self.order, np.int32)[p - (at + 1) // 2], at % 2 == 0


def stitched(opened: DataFrame, at: Boundaries) -> DataFrame:
    """Parts of open nodes with `own_part`, `own_first` (with depth, what they are parts of) and what the boundaries add."""
    sent = opened.sparkSession.sparkContext.broadcast(at)
    last = {at.order[i]: at.across[i + 1] if i + 1 < len(at.order) else -1 for i in range(len(at.order))}
    next_ = opened.sparkSession.sparkContext.broadcast(last)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = sent.value
        for f in frames:
            f["own_part"], f["own_first"] = f["part"], f["is_left"]
            for part, rows in f[f["is_left"]].groupby("part"):
                depth = rows["depth"].to_numpy()
                owner, on_first = b.owners(part, depth)
                f.loc[rows.index, "own_part"], f.loc[rows.index, "own_first"] = owner, on_first
                across = b.across[b.place[part]]
                f.loc[rows.index, "saved"] += np.where(depth <= across, b.saved[b.place[part]], 0)
                f.loc[rows.index, "children"] -= (depth < across).astype(np.int64)
            right = f["is_right"]
            f.loc[right, "leaves"] += f.loc[right, "is_leaf"].to_numpy().astype(np.int64)
            yield f.drop(columns="is_leaf")

    # the last row of a task is a leaf unless the next task's first key goes on from it
    ends = opened.where("is_right").groupBy("part").agg(F.max("depth").alias("deepest"))
    reach = opened.sparkSession.createDataFrame(list(next_.value.items()) or [(0, 0)], "part int, reach int")
    leaf = F.broadcast(ends.join(F.broadcast(reach), "part").select("part", (F.col("reach") < F.col("deepest")).alias("is_leaf")))
    names = [f for f in opened.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", own_part int, own_first boolean"
    return opened.join(leaf, "part").mapInPandas(run, schema)


def digests(chunks: DataFrame) -> DataFrame:
    """own_part, own_first, depth, id, sha: the digest of each run's chunks in order; no run is held whole."""
    keys = ["own_part", "own_first", "depth", "id"]
    schema = pa.schema([("own_part", pa.int32()), ("own_first", pa.bool_()), ("depth", pa.int32()), ("id", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            done = []
            for *key, text in zip(*(b.column(c).to_pylist() for c in (*keys, "ends")), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*at, sha.hexdigest()), schema, strict=True)], schema=schema)

    return chunks.repartition(*keys).sortWithinPartitions(*keys, "part", "chunk").mapInArrow(run, "own_part int, own_first boolean, depth int, id bigint, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix of turn arrays.

    conversations: conv_id and turns as of turn_arrays, one row a conversation. A node is a distinct sequence of first
    turns, the root the empty one; its members are the conversations that start with it, and it is named by the least
    of them. A conversation without turns is a member of the root; without conversations there is no node. Texts count by
    their code points, whatever their length; a conversation's digests, 16 bytes a turn, are one value.
    """
    small_batches(conversations.sparkSession)
    key = F.coalesce(F.aggregate("turns.id", F.lit(b""), lambda a, t: F.concat(a, t)), F.lit(b""))
    keys = written(conversations.select("conv_id", key.alias("key"), F.col("turns.chars").alias("chars")), "keys")
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(swept(keys.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")), "swept")
    at = Boundaries(found)

    parts = written(stitched(found.where("kind = 'open'").drop("kind", "chunk", "first", "last", "own"), at), "parts")
    whole = ["own_part", "own_first", "depth"]
    opened = parts.groupBy(*whole).agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "saved", "leaves")], F.min("conv").alias("conv"), F.max("above").alias("above"), F.max("ends").alias("ends"),
        F.min_by(F.struct("part", "parent"), "part").alias("up"),
    )
    local = parts.select("part", "id", *whole)
    chunks = found.where("kind = 'chunk'").select("part", "id", "chunk", "ends").join(small(local), ["part", "id"], "left")
    lone = F.col("own_part").isNull()  # a long run of a node that is no part of an open one
    named = chunks.select(
        F.coalesce("own_part", "part").alias("own_part"), F.coalesce("own_first", F.lit(False)).alias("own_first"), F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.when(lone, F.col("id")).otherwise(F.lit(-1)).alias("id"), "part", "chunk", "ends",
    )
    shas = small(written(digests(named), "digests"))

    closed = found.where("kind = 'node'").alias("n").join(shas.where("depth < 0").select(F.col("own_part").alias("part"), "id", "sha"), ["part", "id"], "left")
    closed = closed.select("part", "id", F.struct("part", "parent").alias("up"), "depth", "n", "children", "saved", "leaves", "conv", "above", F.coalesce("sha", "ends").alias("ends"))
    opened = opened.join(shas.where("depth >= 0").select(*whole, "sha"), whole, "left")
    opened = written(opened.select(*whole, "up", "n", "children", "saved", "leaves", "conv", "above", F.coalesce("sha", "ends").alias("ends")), "open")

    # every part of an open node answers for it under the id that its task's children know
    names = closed.select("part", "id", "conv", "children").unionByName(parts.select("part", "id", *whole).join(small(opened.select(*whole, "conv", "children")), whole).select("part", "id", "conv", "children"))
    nodes = closed.drop("part", "id").unionByName(opened.drop("own_part", "own_first"))
    nodes = nodes.select("*", F.col("up.part").alias("part"), F.col("up.parent").alias("id")).drop("up")
    return with_parents(written(nodes, "nodes"), written(names.where("children > 0"), "names"))


def with_parents(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The nodes with their parents' names; names of parents with many children are sent, the others met by a shuffle."""
    top = nodes.where("id is null").withColumn("up", F.lit(None).cast("long"))
    many = small(names.where(F.col("children") >= MANY_CHILDREN).select("part", "id", F.col("conv").alias("up")))
    few = names.where(F.col("children") < MANY_CHILDREN).select("part", "id", F.col("conv").alias("up"))
    under = nodes.where("id is not null").join(many.withColumnRenamed("up", "sent"), ["part", "id"], "left")
    rest = under.where("sent is null").drop("sent").join(few, ["part", "id"])
    every = rest.unionByName(under.where("sent is not null").withColumnRenamed("sent", "up")).unionByName(top)
    return every.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of the one that its hundred begins with."""
    return trie(with_heads(turn_arrays(table(spark, sf_dir, "conversations"))))


SQL = f"""
with own as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), bits as (
  select distinct c, list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''), lambda s: [ascii(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))) as steps from own
), ids as (
  select c, c - c % {FAMILY} as base, xor(list_reduce(steps, lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % {HEADS} as h from bits
), turns as (
  select ids.c, o.role, o.text, o.k from ids join own as o on o.c = ids.base and o.k <= ids.h
  union all select ids.c, o.role, o.text, o.k from ids join own as o on o.c = ids.c and o.k > ids.h
), placed as (
  select c, role, text, row_number() over (partition by c order by k) as d, count(*) over (partition by c) as n from turns
), members as materialized (
  select c, 0 as d, '' as node, 0 as chars from ids
  union all select c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by d)) as node, length(text) as chars from placed
), lengths as (
  select c, max(d) as n from members group by c
), nodes as materialized (
  select d, node, min(c) as conv, count(*) as n, any_value(chars) as chars, coalesce(string_agg(c::varchar, ',' order by c) filter (d = l.n), '') as ends from members join lengths as l using (c) group by d, node
), links as materialized (
  select distinct a.d, a.node, b.d as d2, b.node as node2 from members as a join members as b on a.c = b.c and b.d >= a.d
), sums as (
  select l.d, l.node, count(*) filter (l.d2 = l.d + 1) as children, count(*) filter (not exists (select 1 from links as x where x.d = l.d2 and x.node = l.node2 and x.d2 = l.d2 + 1)) as leaves, sum((n.n - 1) * n.chars)::bigint as saved
  from links as l join nodes as n on n.d = l.d2 and n.node = l.node2 group by all
)
select n.conv as conv_id, n.d::bigint as depth, p.conv as parent_conv_id, n.n as n_convs, s.children as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(n.ends) as ends_sha256
from nodes as n join sums as s using (d, node) left join links as l on l.d = n.d - 1 and l.d2 = n.d and l.node2 = n.node left join nodes as p on p.d = l.d and p.node = l.node
"""
