"""State of products' sync cycles from an append-only log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W



def progress(log: DataFrame, key: str, at: str, catalog_ok: Column, price_ok: Column, catalog_bad: Column, price_bad: Column) -> DataFrame:
    """Per key: the last success and failure of both tracks and the first success. A catalog success also counts for prices.

    One pass with conditional aggregates: a key's events are combined before the shuffle.
    """
    when = lambda cond: F.when(cond, F.col(at))
    return log.groupBy(key).agg(
        F.max(when(catalog_ok)).alias("catalog_success_at"),
        F.max(when(catalog_ok | price_ok)).alias("price_stock_success_at"),
        F.min(when(catalog_ok | price_ok)).alias("first_success_at"),
        F.max(when(catalog_bad)).alias("catalog_failure_at"),
        F.max(when(price_bad)).alias("price_stock_failure_at"),
    )


def _ahead(success: str, failure: str) -> Column:
    """Success at or after any failure."""
    return F.col(success).isNotNull() & (F.col(failure).isNull() | (F.col(failure) <= F.col(success)))


def _behind(success: str, failure: str) -> Column:
    return F.col(failure).isNotNull() & (F.col(success).isNull() | (F.col(failure) > F.col(success)))


def classified(progress: DataFrame) -> DataFrame:
    """progress with both tracks' verdicts, the latest success and failure, and cycle_state."""
    tracks = (("catalog_success_at", "catalog_failure_at"), ("price_stock_success_at", "price_stock_failure_at"))
    (variant, price), (worse, worse_price) = [_ahead(*t) for t in tracks], [_behind(*t) for t in tracks]
    return progress.select(
        "*",
        variant.alias("variant_verified"),
        price.alias("price_stock_verified"),
        F.greatest("catalog_success_at", "price_stock_success_at").alias("latest_success_at"),
        F.greatest("catalog_failure_at", "price_stock_failure_at").alias("latest_failure_at"),
        F.when(variant & price, "verified").when(worse | worse_price, "failed").otherwise("pending").alias("cycle_state"),
    )


def summary(states: DataFrame, now: Column) -> DataFrame:
    """One row: counts by state, throughput of the last 24 hours, and what is left."""
    done = F.col("cycle_state") == "verified"
    recent = done & (F.col("latest_success_at") >= now - F.expr("INTERVAL 24 HOURS"))
    one = states.agg(
        F.count("*").alias("state_total"),
        F.count_if("variant_verified").alias("variant_verified"),
        F.count_if("price_stock_verified").alias("price_stock_verified"),
        F.count_if(done).alias("fully_verified"),
        F.count_if(F.col("cycle_state") == "failed").alias("failed"),
        F.count_if(F.col("cycle_state") == "pending").alias("pending"),
        F.count_if(recent).alias("recent_verified"),
        F.min(F.when(recent, F.col("latest_success_at"))).alias("recent_started_at"),
        F.max(now).alias("now"),
    )
    seconds = F.greatest(F.lit(60.0), (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("recent_started_at").cast("timestamp"))) / 1e6)
    rate = F.when(F.col("recent_started_at").isNotNull(), F.floor(F.col("recent_verified") / seconds * 36000 + 0.5) / 10).otherwise(0.0)
    left = F.greatest(F.lit(0), F.col("state_total") - F.col("fully_verified"))
    out = one.withColumn("rate_per_hour", rate).withColumn("remaining", left)
    percent = F.when(F.col("state_total") > 0, F.floor(F.col("fully_verified") / F.col("state_total") * 1000 + 0.5) / 10).otherwise(0.0)
    hours = F.when(F.col("rate_per_hour") > 0, F.floor(F.col("remaining") / F.col("rate_per_hour") * 10 + 0.5) / 10)
    return out.withColumn("completion_percent", percent).withColumn("hours_remaining", hours).drop("now")


def since_last_success(log: DataFrame, key: str, at: str, ok: Column, bad: Column, needed: int = 2) -> DataFrame:
    """Per key: failures after its last success, and whether they reach the number (kept within 2 to 3) that confirms."""
    healthy = F.max(F.when(ok, F.col(at))).over(W.Window.partitionBy(key))
    late = log.withColumn("_healthy", healthy)
    count = F.count_if(bad & (F.col("_healthy").isNull() | (F.col(at) > F.col("_healthy"))))
    return late.groupBy(key).agg(count.alias("failures_since")).withColumn("confirmed", F.col("failures_since") >= min(3, max(2, needed)))


def latest(log: DataFrame, key: str, at: str, tie: str, n: int = 1) -> DataFrame:
    """The n last events of every key, ties to the greater `tie`, with rank."""
    order = W.Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def within_window(log: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Each event with how many of its key's lie in the last `seconds` up to it, whether that exceeds the limit, and the wait."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    frame = W.Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    out = log.withColumn("_us", micros).withColumn("in_window", F.count("*").over(frame)).withColumn("_oldest", F.min("_us").over(frame))
    limited = F.col("in_window") >= limit
    wait = F.when(limited, F.col("_oldest") + seconds * 1_000_000 - F.col("_us")).otherwise(0)
    return out.withColumn("limited", limited).withColumn("wait_us", wait).drop("_us", "_oldest")
