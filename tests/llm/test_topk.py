"""Exact top-k search against all products in Python's integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import topk
from millrace.llm.registry import SQL
from tests.oracle import same


def usable(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, top: int, every: int = 50) -> list[tuple]:
    kept = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and usable(v)]
    out = []
    for i, (q, a) in enumerate(kept):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), k) for j, (k, b) in enumerate(kept) if j != i)[:top]
            out += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores)]
    return sorted(out)


def got(df, **of) -> list[tuple]:
    return sorted(map(tuple, topk.top_scores(df, lambda k: k % 50 == 0, **of).collect()))


@pytest.mark.parametrize(("lists", "width"), [(1, 5), (2, 8), (3, 8), (4, 3)])
def test_like_all_products(spark, monkeypatch, lists, width):
    for name, n in (("ENTRIES", 60), ("QUERIES", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(lists)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(width - (i % 7 == 0))]) for i in range(400)]
    rows += [(1000 + i, [0.5] * width) for i in range(300)] + [(50, [0.5] * width)]  # a vector of many rows, and an id of two
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert got(df, lists=lists) == plain(rows, 5)


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (1, [2.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [0.0, 0.0]), (None, [9.0, 9.0]), (50, []), (8, [0.001, -0.001])]
    df = spark.createDataFrame([(k, v, "s", 1) for k, v in rows], "vec_id bigint, embedding array<float>, score string, row int").withColumn("list", F.lit(None).cast("int"))
    assert got(df) == plain(rows, 5)
    assert got(df.limit(0)) == [] and got(df.where("vec_id = 1")) == [] and got(df.where("vec_id = 0")) == []


def test_large_components_are_exact_or_an_error(spark):
    rows = [(0, [3e6, 1.0]), (1, [2999999.75, -1.0]), (2, [3e6, 1.0]), (3, [-3e6, 5.0]), (4, [3e6, 1.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df) == plain(rows, 5)
    with pytest.raises(ValueError, match="too large"):
        got(spark.createDataFrame([(0, [1e30])], "vec_id bigint, embedding array<double>"))


def test_nodes_send_few_entries(spark):
    """Of vectors without structure the second phase asks for far fewer pairs than there are."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    asked = []
    ask = topk.Lists.ask
    try:
        topk.Lists.ask = lambda self, queries, answer: asked.append(ask(self, queries, answer)) or asked[-1]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        assert got(df) == plain(rows, 5)
    finally:
        topk.Lists.ask = ask
    assert asked[1].select("query", "row").distinct().count() < 0.2 * 60 * 3000


def test_query(spark, data):
    same(spark, topk.op12_exact_topk, SQL["op12_exact_topk"], data)
