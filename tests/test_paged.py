"""Resumable pages, reports that are whole or not there, upserts that can be repeated."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import paged


def pages_read(spark, source, state, out, until=None):
    spark.dataSource.register(paged.PagedStream)
    reader = spark.readStream.format("paged_stream").schema("id long, title string, page int").option("path", str(source)).option("columns", "id,title").option("page", 10)
    stream = (reader if until is None else reader.option("until", until)).load()
    stream.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out)).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()))


def test_scan_goes_on_with_the_next_page(spark, tmp_path):
    rows = spark.range(95).select("id", F.concat(F.lit("t"), "id").alias("title"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 256).parquet(str(tmp_path / "in"))
    want = [(i, f"t{i}", i // 10) for i in range(95)]
    where = (tmp_path / "in", tmp_path / "state", tmp_path / "out")
    assert pages_read(spark, *where, until=3) == want[:30]
    assert pages_read(spark, *where, until=3) == want[:30]  # nothing new
    assert pages_read(spark, *where, until=7) == want[:70]
    assert pages_read(spark, *where) == want  # the last page is short; each was read once


def test_report_is_whole_or_not_there(spark, tmp_path):
    spark.dataSource.register(paged.JsonReport)
    path = str(tmp_path / "report")
    lines = lambda: sorted(r["line"] for r in spark.read.format("json_report").load(path).collect())
    rows = spark.range(40, numPartitions=4).select("id", F.lit("é\n").alias("t"))
    rows.write.format("json_report").mode("append").save(path)
    want = sorted(f'{{"id":{i},"t":"é\\n"}}' for i in range(40))
    assert lines() == want
    with pytest.raises(Exception, match="at 39"):
        rows.select(F.when(F.col("id") == 39, F.raise_error(F.lit("at 39"))).otherwise(F.col("id")).cast("long").alias("id")).write.format("json_report").mode("append").save(path)
    assert lines() == want and len(list((tmp_path / "report").glob("job-*"))) == 1
    rows.limit(0).write.format("json_report").mode("append").save(path)
    assert lines() == want
    rows.limit(1).select("id").write.format("json_report").mode("overwrite").save(path)
    assert lines() == ['{"id":0}']


def test_upserts_by_batch(spark, tmp_path):
    table = paged.UpsertTable(spark, str(tmp_path / "table"), "k long, v string, at int", ["k"], buckets=4)
    rows = lambda: sorted(map(tuple, table.rows().collect()))
    frame = lambda *r: spark.createDataFrame(r, "k long, v string, at int")
    assert rows() == []
    table.upsert(frame(*[(i, "a", 0) for i in range(20)]), 0)
    table.upsert(frame((3, "b", 1), (3, "c", 2), (99, "new", 1)), 1, ["at"])
    want = sorted([(i, "a", 0) for i in range(20) if i != 3] + [(3, "c", 2), (99, "new", 1)])
    assert rows() == want
    table.upsert(frame((3, "b", 1), (3, "c", 2), (99, "new", 1)), 1, ["at"])  # repeated
    assert rows() == want
    with pytest.raises(Exception, match="broken"):
        table.upsert(frame((4, "x", 3)).withColumn("v", F.raise_error(F.lit("broken")).cast("string")), 2)
    assert rows() == want
    table.upsert(frame(), 2)
    assert rows() == want


def test_upserts_from_a_stream(spark, data, tmp_path):
    """Two runs over events in many files leave each user's last event; the table is that of a batch."""
    from millrace.streaming import incremental

    spark.read.parquet(f"{data}/events.parquet").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    table = paged.UpsertTable(spark, str(tmp_path / "table"), "user_id long, event_id long, event_type string", ["user_id"], buckets=3)
    stream = incremental.read_stream(spark, str(tmp_path), "events", 2).select("user_id", "event_id", "event_type")

    def keep(df, number):  # the last by event_id, also against what the table has
        table.upsert(df.unionByName(table.rows().join(df.select("user_id").distinct(), "user_id", "left_semi")), number, ["event_id"])

    for _ in range(2):
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e")).select("user_id", "e.*")
    assert sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, want.collect()))
