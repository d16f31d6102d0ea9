import numpy as np
import pytest

from millrace.llm import neighbours
from millrace.llm.common import table


def products(q, e) -> np.ndarray:
    """One vector's inner products with others, summed in order of the components; shorter vectors end in zeros."""
    width = max(len(q), *map(len, e))
    full = np.zeros((len(e), width))
    for i, v in enumerate(e):
        full[i, : len(v)] = v
    out = np.zeros(len(e))
    for i, x in enumerate(q):
        out += float(x) * full[:, i]
    return out


def exact(rows: list[tuple[int, list]], top: int, every: int = 20) -> dict[tuple, list[tuple[int, float]]]:
    """The nearest of every query row: all rows but its own, ties to the smaller id."""
    e, out = [v for _, v in rows], {}
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            s = products(v, e)
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[j], rows[j][0]))[:top]
            out[q, *v] = [(rows[j][0], float(s[j])) for j in order]
    return out


def by_query(df) -> list[list[tuple[int, float]]]:
    """The answers of each query in order of rank; one query to an id."""
    got: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("n", [500, 2_000, 10_000])
def test_recall_and_scores(spark, n, tmp_path):
    """Vectors with as little structure as those of the tables: 500 and 2,000 are the tables', 10,000 are drawn."""
    data = f"/root/testdata/sf{'0.01' if n == 500 else '0.1'}"
    if n == 10_000:
        e = np.random.default_rng(5).normal(size=(n, 64))
        e = (e / np.linalg.norm(e, axis=1)[:, None]).astype(np.float32)
        spark.createDataFrame([(i, v) for i, v in enumerate(e.tolist())], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
        data = str(tmp_path)
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, data, "embeddings").collect() if r["embedding"]]
    e = np.array([v for _, v in rows], np.float64)
    got = by_query(neighbours.op4_nearest_neighbours(spark, data))
    hits = all_ = 0
    place = {k: i for i, (k, _) in enumerate(rows)}
    assert got.keys() == {k for k, _ in rows if k % 20 == 0}
    for q, found in got.items():
        s = e @ e[place[q]]
        s[place[q]] = -np.inf
        want = {rows[i][0] for i in np.argpartition(-s, 20)[:20]}
        hits, all_ = hits + len(want & {v for v, _ in found}), all_ + 20
        assert len(found) == 20 and [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found)
        assert [s for _, s in found[:3]] == products(e[place[q]], [e[place[v]] for v, _ in found[:3]]).tolist()
    assert hits >= 0.9 * all_


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 5.0]), (3, [2.0, -3.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [2.0, 5.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id bigint, embedding array<float>, score string")
    got = neighbours.nearest(df, lambda k: k % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (0, 4, 3, 2.0), (0, 5, 9, 1.0), (0, 6, 10, -1.0)]
    assert neighbours.nearest(df.limit(0), lambda k: k % 20 == 0).collect() == []


def test_rows_that_repeat_an_id_are_candidates_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [2.0, 0.0]), (0, [0.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda k: k % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 0, 0.0), (0, 1, 1, 5.0), (0, 2, 1, 0.0), (0, 2, 1, 2.0), (0, 3, 0, 0.0), (0, 3, 1, 0.0)]


def test_full_cells_are_split(spark, monkeypatch):
    for name, n in (("ENTRIES", 16), ("QUERIES", 4), ("AT_ONCE", 3)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i % 3 == 0 else rng.normal(size=4 - i % 2).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = exact(rows, 20)
    assert by_query(neighbours.nearest(df, lambda k: k % 20 == 0, share=1.0, k=4)) == {k[0]: v for k, v in want.items()}


def test_clustered_vectors_need_few_entries(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 16))
    plan = neighbours.Index(neighbours.lifted(x[::2], (x * x).sum(axis=1).max()), 32)
    assert neighbours.calibrated(plan, x[1::2], (x * x).sum(axis=1).max(), 4000, 20, 0.95) < 0.1


def test_heap_takes_cells_by_summed_distance():
    rng = np.random.default_rng(3)
    plan = neighbours.Index(rng.normal(size=(200, 6)), 8)
    sizes = rng.integers(0, 9, plan.shape)
    a, b = rng.random(8), rng.random(8)
    for wanted in (1, 30, int(sizes.sum())):
        order = sorted((a[i] + b[j], i, j) for i in range(8) for j in range(8))
        held = np.cumsum([sizes[i, j] for _, i, j in order])
        assert plan.radius(a, b, sizes, wanted) == order[int(np.searchsorted(held, wanted))][0]
