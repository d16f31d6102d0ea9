"""Work that must not grow faster than the tables, held small."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import options
from millrace.operators import matching
from millrace.registry import QUERIES, SQL
from millrace.sources import web
from millrace.streaming import stateful
from tests.oracle import same


def test_a_ladder_reads_its_title_once(spark, data):
    """Ages stand outside the lambda over the steps, which would read them for each of its 17 steps."""
    plan = QUERIES["e19_repaired_variants"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("baby|babies") == 1 and plan.count("up to") == 1
    titles = {None: 0, "": 0, "Romper (3mths-8yrs)": 11, "Romper (99999999999mths - 2yrs)": 7, "up to 2-3 years": 8, "BABY set": 8, "3 months": 0}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", F.size(options.size_ladder(F.col("t"))).alias("n")).collect()
    assert dict(map(tuple, got)) == titles


def test_keys_share_slots_of_state(spark, tmp_path):
    """Rows of 6,000 keys wait in a few entries of state, not in several a key, and come out for every key."""
    spark.range(6000).selectExpr("id as event_id", "id % 3000 as k", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as ts").write.parquet(str(tmp_path / "rows.parquet"))
    source = spark.readStream.schema("event_id long, k long, ts timestamp").parquet(str(tmp_path / "rows.parquet"))
    replay = stateful.Replay(spark, "slots", str(tmp_path / "state"))
    out = stateful.folded(replay.closed(source, "k", "ts"), "k", "ts", "900 days", stateful.unseen_fold(3600), slots=16)
    query = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "held")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 3000
    replay.run(out)
    got = replay.close(out, dt.datetime(2040, 1, 1))  # noqa: DTZ001
    assert got.count() == got.select("event_id").distinct().count() == 6000


def test_cycles_do_not_copy_their_items():
    """A row changes its item in place: a copy of all items for every row is quadratic. The start stays empty."""
    fold = stateful.cycle_fold(86_400, 3, 1)
    one, _ = fold.step(fold.start, 1, ("a", "x", True))
    two, _ = fold.step(one, 2, ("b", "y", False))
    assert two[1] is one[1] and set(two[1]) == {"a", "b"} and fold.start == (None, {})
    assert fold.end(two, 86_400_000_000)[1] == [(0, "a", "first", True), (0, "b", "first", False)]


@pytest.mark.parametrize("name", ["j14_code_in_sku", "j17_weighted_score"])
def test_exploded_rows_are_not_broadcast(spark, data, name):
    """What is exploded is many times the file it comes from, whose size is all that a plan knows."""
    assert "Broadcast" not in QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_evidence_makes_no_pairs(spark, data):
    """60,000 parts of one vendor and title would be 900,000,000 pairs; one left part stands beside a single right one."""
    side = lambda rest: spark.range(60_000).where(f"id % 2 = {rest}").selectExpr("id", "id as pos", "'v' as vendor", "'hot' as exact", "'hot' as base", "'u' || id as url")
    few = [(100_000, None, "w", "t", "b", None), (100_002, None, "w", "t", "other", None), (100_004, None, "w", None, "c", None), (100_006, None, None, "t", "b", None)]
    there = [(1, 1, "w", "t", "b", "u1"), (2, 3, "w", "x", "b", "u1"), (3, 0, "w", "y", "other", "u2"), (4, 9, "w", None, "c", "u3"), (5, 4, "w", None, "c", None)]
    schema = "id long, pos long, vendor string, exact string, base string, url string"
    left, right = side(0).unionByName(spark.createDataFrame(few, schema)), side(1).unionByName(spark.createDataFrame(there, schema))
    out = matching.unique_evidence(left.drop("pos", "url"), right, [["vendor", "exact"], ["vendor", "base"]], "id", "url", "pos")
    assert sorted(map(tuple, out.select("id", "pos", "url").collect())) == [(100_000, 1, "u1"), (100_004, 4, "u3")]
    plan = QUERIES["j13_unique_evidence"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join LeftOuter") == 2 and plan.count("Aggregate") == 3


def test_index_row_of_parts_beyond_a_million(spark, tmp_path):
    rows = [(1, 1, 1_150_000, "N"), (1, 2, 100_000, "N"), (2, 1, 1_150_000, "A"), (2, 2, 100_000, "A"), (2, 1, 5, "N"), (3, 1, None, "A"), (3, 2, 7, "N"), (4, 3, 900_000, "A"), (4, 2, 1_200_000, "R")]
    spark.createDataFrame([(o, n, p, f, 2.0, 10.0 * n) for o, n, p, f in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    same(spark, QUERIES["a20_index_row"], SQL["a20_index_row"], str(tmp_path))


def test_pages_are_read_in_runs(spark, tmp_path):
    """A task reads the row groups of its run of pages, not the whole catalog for each page; rows of a page may stand in two files."""
    spark.range(1010).selectExpr("id as k", "'t' || id as t").repartitionByRange(7, "k").sortWithinPartitions("k").write.option("parquet.block.size", 1024).parquet(str(tmp_path / "c.parquet"))
    for page, total, runs in ((50, 1010, 7), (5, 1010, 8), (50, 120, 3)):
        reader = web.PagedReader({"path": str(tmp_path / "c.parquet"), "total": str(total), "page": str(page), "key": "k", "title": "t"})
        parts = reader.partitions()
        assert len(parts) == runs and sum(g.end - g.start for p in parts for g in p.groups) == total
        assert [(r[0], r[1], r[3]) for p in parts for r in reader.read(p)] == [(str(i), f"t{i}", i // page) for i in range(total)]


def test_a_markdown_page_is_cut_into_lines_once(spark, data):
    """What is named several times in a lambda or a case is computed as often, unless it is held by `once`."""
    plan = QUERIES["e32_markdown_pages"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("now AED") == 1 and plan.count("(?i)vat$") == 1 and plan.count("(?i)^sizes?$") == 1


def test_codes_of_keys_beyond_six_digits(spark, tmp_path):
    spark.createDataFrame([(k, n, "b", t, 1) for k in (7, 123_456, 1_234_565, 1_234_567) for n, t in (("red cup", "TIN"), ("hot bolt", "ECONOMY"))], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same(spark, QUERIES["j14_code_in_sku"], SQL["j14_code_in_sku"], str(tmp_path))
