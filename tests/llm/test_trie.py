"""The trie against a plain one of dictionaries, on one task and on many."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import trie
from millrace.llm.registry import SQL
from tests.oracle import same


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return out


def plain(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves = sum(sums[k][0] for k in kids) or 1
        saved = sum(sums[k][1] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made(seed: int, convs: int, words: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50 if seed % 2 else 0, 400), convs):
        for turn in range(rng.choice([1, 2, 3, most])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", "ab\U0001f600"[: 1 + rng.randrange(words)] * rng.choice([1, 1, 1, 40])))
    return rows


@pytest.mark.parametrize(("tasks", "seed", "words", "most"), [(1, 1, 2, 12), (3, 0, 1, 4), (16, 2, 3, 6), (16, 3, 1, 90)])
def test_like_a_plain_trie(spark, monkeypatch, tasks, seed, words, most):
    monkeypatch.setattr(trie, "MANY_CHILDREN", 2)
    rows = made(seed, 60, words, most)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
        assert got(trie.trie(trie.with_heads(trie.turn_arrays(df)))) == plain(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_over_many_tasks(spark):
    """One conversation held by most, whose digest is read over all tasks; one inside a task of its own."""
    rows = [(c, t, "user", f"text {t}") for c in range(0, 300) for t in range(6, 8)] + [(500 + c, 9, "user", "other") for c in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        assert got(trie.trie(trie.turn_arrays(df))) == plain({c: [(r, t) for x, _, r, t in rows if x == c] for c in {r[0] for r in rows}})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("cuts", [1, 2, 7, 40])
def test_sweep_in_short_chunks(spark, monkeypatch, cuts):
    """Sweeps of made tasks, with runs of a few ids sent as chunks also where no boundary is near."""
    monkeypatch.setattr(trie, "CHUNK", 6)
    convs = {c: [("u", "abc"[(c // 7) % 3])] * (c % 4) + [("u", "z")] * (c % 5 // 4) for c in range(120)}
    id_ = lambda turn: hashlib.sha256(str(turn).encode()).digest()[: trie.TURN]
    order = sorted((b"".join(map(id_, t)), c, [len(x) for _, x in t]) for c, t in convs.items())
    out = []
    for p in range(cuts):
        sweep = trie.Sweep(3 * p)  # tasks without rows are between
        for row in order[p * len(order) // cuts : (p + 1) * len(order) // cuts]:
            sweep.add(*row)
        sweep.finish()
        out += sweep.out
    monkeypatch.setattr(trie, "swept", lambda _: spark.createDataFrame([tuple(r.get(f.name) for f in trie.ARROW) for r in out], trie.KIND))
    empty = spark.createDataFrame([], "conv_id bigint, turns array<struct<id:binary,chars:bigint>>")
    assert got(trie.trie(empty)) == plain(convs)


def test_common_turns():
    a, b, c = (bytes([i]) * trie.TURN for i in range(3))
    half = b[:8] + c[8:]
    assert [trie.common(x, y) for x, y in ((b"", a), (a, a), (a + b, a + b + c), (a + b, a + c), (b, half), (a + b + c, a + half + c))] == [0, 1, 2, 1, 0, 1]


def test_odd_rows(spark):
    rows = [
        (100, None, None, None), (100, 1, "user", "x"), (100, 1, "user", "x"), (100, 0, "a", ""), (101, 2, "user", "x"), (101, 2, "assistant", "x"), (None, 0, "user", "x"), (7, 5, "user", "long " * 50_000), (207, 5, None, "y"),
        (3, 0, "us", "er"), (4, 0, "use", "r"), (5, 0, "us", "er"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("_base", F.lit("mine")).withColumn("turns", F.lit(1)).withColumn("part", F.lit("x"))
    assert got(trie.trie(trie.with_heads(trie.turn_arrays(df)))) == plain(rebuilt(rows))
    assert got(trie.trie(trie.with_heads(trie.turn_arrays(df.limit(0))))) == []


def test_query(spark, data):
    same(spark, trie.op11_conversation_trie, SQL["op11_conversation_trie"], data)
