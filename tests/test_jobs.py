"""Single flight, recovery, and scans that are taken up again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import jobs
from millrace.sources import paged
from millrace.streaming import stateful

START = dt.datetime(2024, 1, 1)  # noqa: DTZ001


def test_single_flight(spark):
    rng = random.Random(5)
    asks = [(i, rng.choice("ab"), START + dt.timedelta(minutes=rng.randrange(4000)), rng.choice([None, 600.0, 5400.0])) for i in range(300)]
    want, running = [], {}
    for i, k, at, seconds in sorted(asks, key=lambda r: (r[1], r[2], r[0])):
        job = running.get(k)
        if job and at <= job[1] + dt.timedelta(hours=1) and (job[2] is None or at < job[1] + dt.timedelta(seconds=job[2])):
            want.append((i, job[0], True))
        else:
            running[k] = (i, at, seconds)
            want.append((i, i, False))
    df = spark.createDataFrame(asks, "event_id bigint, k string, ts timestamp, seconds double").repartition(5)
    got = stateful.folded_batch(df, "k", "ts", jobs.single_flight(3600))
    assert sorted(map(tuple, got.select("event_id", "job", "joined").collect())) == sorted(want) and {w[2] for w in want} == {True, False}
    assert stateful.folded_batch(df.limit(0), "k", "ts", jobs.single_flight(3600)).collect() == []


def test_batch_folds_end_like_streams(spark, data, tmp_path):
    """Cycles that end after the last row end in a table as they do in a stream."""
    from millrace.plans import streams
    from tests.test_streaming import dealt

    e = spark.read.parquet(f"{data}/events.parquet")
    item, content = F.concat(F.lit("row "), F.col("user_id").cast("string")), F.concat_ws("|", "event_type", F.floor(F.col("value") / 10).cast("string"))
    rows = e.withColumns({"sheet": F.pmod(F.col("user_id"), F.lit(8)), "item": item, "content": content, "works": F.col("event_type") != "error"})
    got = stateful.folded_batch(rows, "sheet", "ts", stateful.cycle_fold(86_400, 3, 1))
    want = streams.t02_streamed_cycles(spark, dealt(spark, data, tmp_path, 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_recovery(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [
        (1, "SYNC_PRODUCT", "pending", "p", at(0), None), (2, "SYNC_PRODUCT", "running", " p ", at(1), None), (3, "SYNC_PRODUCT", "running", "p", at(2), at(995)), (4, "SYNC_PRODUCT", "running", "q", at(3), at(990)),
        (5, "SYNC_PRODUCT", "pending", "", at(4), None), (6, "SYNC_PRODUCT", "pending", None, at(5), None), (7, "SYNC_INVENTORY", "pending", "p", at(6), None), (8, "IMPORT", "pending", "p", at(7), None),
        (9, "SYNC_PRODUCT", "completed", "z", at(8), None), (10, "SYNC_PRODUCT", "pending", "q", at(9), None), (11, "SYNC_PRODUCT", "pending", "late", at(10), None),
    ]
    df = spark.createDataFrame(rows, "job int, type string, status string, product string, created timestamp, started timestamp")
    got = jobs.recovered(df, F.lit(at(1000)), 10, 7)
    assert sorted(map(tuple, got.collect())) == [(1, "pending"), (2, "completed"), (4, "pending"), (5, "pending"), (6, "pending"), (7, "pending"), (10, "completed")]


def test_a_scan_that_is_not_whole_drops_nothing(spark, tmp_path):
    spark.range(120).select("id").repartitionByRange(2, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "catalog"))
    index = paged.UpsertTable(spark, str(tmp_path / "index"), "id long, scan string", ["id"], buckets=2)
    index.upsert(spark.createDataFrame([(999, "a")], "id long, scan string"), -1)
    job = jobs.CatalogJob(spark, str(tmp_path), str(tmp_path / "catalog"), "id", "id long", index, "b")
    job.run(lambda df: df.select("id"), 1)
    assert index.rows().count() == 51
    with pytest.raises(ValueError, match="50 of 120"):
        job.finish(120)
    job.run(lambda df: df.select("id"))
    assert sorted(r["id"] for r in job.finish(120).collect()) == list(range(120))
