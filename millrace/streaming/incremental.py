"""Incremental forms: what a poll recomputes, as Structured Streaming queries.

Each takes a streaming frame and returns one; `drain` runs a query over what is there and stops, so that results can
be held against the batch forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons


def unseen(rows: DataFrame, at: str, ttl: str = "720 hours") -> DataFrame:
    """Rows whose content has not been seen within the time to live; a changed row is new. Rows as GoogleSheet rows."""
    h = jsons.fingerprint(F.col("url"), F.col("price"), F.col("price_multiplier"), F.col("collection"), F.col("sku"))
    return rows.withColumn("hash", h).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["hash"])


def unseen_batch(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """The same against a table of hashes."""
    h = jsons.fingerprint(F.col("url"), F.col("price"), F.col("price_multiplier"), F.col("collection"), F.col("sku"))
    return rows.withColumn("hash", h).join(seen.select("hash"), "hash", "left_anti")


def trailing_counts(events: DataFrame, at: str, kind: str, size: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Counts by window and kind; a window is final once the watermark has passed it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all there is, into a table in memory of that name."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 100) -> DataFrame:
    """A table's files as a stream, so many a batch. A table of one file is streamed out of the folder that it is in."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_a_batch)
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [f"{name}.parquet"]:
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)
