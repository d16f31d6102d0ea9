"""Codes with bounds against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codes
from millrace.llm.registry import SQL
from tests.oracle import same


def plain(rows, parts: int, entries: int, rounds: int, scale: int):
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    step = -(-max((len(x) for _, x in kept), default=0) // parts)
    kept = [(k, x + [0] * (parts * step - len(x))) for k, x in kept]
    cut = lambda x: [x[p * step : p * step + step] for p in range(parts)]
    cuts = [cut(x) for _, x in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(first)), key=lambda e: (far(x[p], books[p][e]), e)) for p in range(parts)] for x in cuts]
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(len(first)):
                own = [x[p] for x, c in zip(cuts, code, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    code = assign()
    return sorted((str(k), bytes(c), sum(far(x[p], books[p][c[p]]) for p in range(parts))) for (k, _), x, c in zip(kept, cuts, code, strict=True)), books


def got(df, **of):
    out, books = codes.compressed(df, **of)
    return sorted((str(r["vec_id"]), bytes(r["code"]), r["error"]) for r in out.collect()), books.tolist()


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(8, 16, 6, 4096), (2, 3, 4, 4), (3, 5, 0, 2), (4, 7, 9, 1)])
def test_like_plain_rounds(spark, parts, entries, rounds, scale):
    rng = random.Random(parts)
    centres = [[rng.gauss(0, 2) for _ in range(16)] for _ in range(6)]
    rows = [(i * 3 % 251, [x + rng.gauss(0, 0.5) for x in rng.choice(centres)][: 16 - (i % 11 == 0)]) for i in range(300)]
    rows += [(900 + i, [1.0] * 16) for i in range(200)] + [(1 + i, [0.0] * 16) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    assert got(df, parts=parts, entries=entries, rounds=rounds, scale=scale) == plain(rows, parts, entries, rounds, scale)


def test_odd_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, -1.0, 0.5]), (2, [2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (6, [inf]), (7, []), (None, [1.0, 1.0]), (5, [1.0, -1.0, 0.5]), (1, [-0.0001])]
    df = spark.createDataFrame([(k, v, "c", "e") for k, v in rows], "vec_id bigint, embedding array<float>, code string, error string").withColumn("x", F.lit(1))
    want, books = plain(rows, 8, 16, 6, 4096)
    assert got(df) == (want, books)
    out, books = codes.compressed(df.limit(0))
    assert out.collect() == [] and books.size == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert got(df.where("vec_id = 7")) == ([("7", bytes(8), 0)], [[[]]] * 8)
    with pytest.raises(ValueError, match="too large"):
        codes.compressed(spark.createDataFrame([(0, [1e30])], "vec_id bigint, embedding array<double>"))
    with pytest.raises(ValueError, match="one byte"):
        codes.compressed(df, entries=300)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 6)) * 900).astype(np.int64)[rng.integers(0, 40, 2000)] + rng.integers(-90, 90, (2000, 6))
    book = x[:16].copy()
    code, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf, np.float32), np.zeros((2000, 16), np.float32)
    took = []
    for _ in range(8):
        took.append(codes.reassigned(x, book, code, upper, lower))
        d = codes.squared(x[:, None], book[None])
        assert (code == d.argmin(axis=1)).all()
        assert (upper.astype(float) >= np.sqrt(d.min(axis=1))).all() and (lower.astype(float) <= np.sqrt(d)).all()
        new = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(16)])
        moved = codes.above(np.sqrt(codes.squared(book, new))).astype(float)
        upper, lower, book = codes.above(upper + moved[code]), codes.below(lower.astype(float) - moved), new
    assert took[0] <= 16 * 2000 and max(took[3:]) < 0.4 * took[0]


def test_query(spark, data):
    same(spark, codes.op13_vector_codes, SQL["op13_vector_codes"], data)
