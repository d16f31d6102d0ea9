"""Queries over the event log: `events` stands for the audit log, user_id for the product.

purchase is a catalog success, signup a price and stock success, error a catalog failure, click a price and stock
failure; views say nothing. `now` is the log's last timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import cycle
from .base import Tables, query

KINDS = {"catalog_ok": "purchase", "price_ok": "signup", "catalog_bad": "error", "price_bad": "click"}
FIRST_DAY = "2024-01-02"


def _is(kind: str):
    return F.col("event_type") == kind


def _progress(log: DataFrame) -> DataFrame:
    return cycle.progress(log.where(F.col("event_type").isin(*KINDS.values())), "user_id", "ts", **{k: _is(v) for k, v in KINDS.items()})


PROGRESS = """progress as (select user_id, max(ts) filter (where event_type = 'purchase') as catalog_success_at,
    max(ts) filter (where event_type in ('purchase', 'signup')) as price_stock_success_at, min(ts) filter (where event_type in ('purchase', 'signup')) as first_success_at,
    max(ts) filter (where event_type = 'error') as catalog_failure_at, max(ts) filter (where event_type = 'click') as price_stock_failure_at
    from {log} where event_type in ('purchase', 'signup', 'error', 'click') group by user_id)"""
STATES = """states as (select *, catalog_success_at is not null and (catalog_failure_at is null or catalog_failure_at <= catalog_success_at) as variant_verified,
    price_stock_success_at is not null and (price_stock_failure_at is null or price_stock_failure_at <= price_stock_success_at) as price_stock_verified,
    greatest(catalog_success_at, price_stock_success_at) as latest_success_at, greatest(catalog_failure_at, price_stock_failure_at) as latest_failure_at from progress),
    classified as (select *, case when variant_verified and price_stock_verified then 'verified'
      when (catalog_failure_at is not null and (catalog_success_at is null or catalog_failure_at > catalog_success_at))
        or (price_stock_failure_at is not null and (price_stock_success_at is null or price_stock_failure_at > price_stock_success_at)) then 'failed' else 'pending' end as cycle_state from states)"""
WITH = f"with {PROGRESS.format(log='events')}, {STATES}"
EARLY = f"with early as (select * from events where ts < timestamp '{FIRST_DAY}'), {PROGRESS.format(log='early')}, {STATES}"


@query(f"with {PROGRESS.format(log='events')} select * from progress")
def a03_conditional_extremes(spark, sf_dir):
    """Last and first times by condition, per product."""
    return _progress(Tables(spark, sf_dir).events)


@query(f"{WITH} select user_id, catalog_success_at, price_stock_success_at, catalog_failure_at, price_stock_failure_at, variant_verified, price_stock_verified, latest_success_at, latest_failure_at, cycle_state from classified")
def a04_cycle_state(spark, sf_dir):
    """State of every product's cycle."""
    return cycle.classified(_progress(Tables(spark, sf_dir).events)).drop("first_success_at")


@query(f"{EARLY} select user_id, cycle_state from classified")
def a04_cycle_state_first_day(spark, sf_dir):
    """The same after one day, when some products are still pending."""
    log = Tables(spark, sf_dir).events.where(F.col("ts") < F.lit(FIRST_DAY).cast("timestamp"))
    return cycle.classified(_progress(log)).select("user_id", "cycle_state")


@query(f"""{EARLY}, one as (select count(*) as state_total, count(*) filter (where variant_verified) as variant_verified, count(*) filter (where price_stock_verified) as price_stock_verified,
    count(*) filter (where cycle_state = 'verified') as fully_verified, count(*) filter (where cycle_state = 'failed') as failed, count(*) filter (where cycle_state = 'pending') as pending,
    count(*) filter (where cycle_state = 'verified' and latest_success_at >= timestamp '{FIRST_DAY}' - interval 24 hours) as recent_verified,
    min(latest_success_at) filter (where cycle_state = 'verified' and latest_success_at >= timestamp '{FIRST_DAY}' - interval 24 hours) as recent_started_at from classified),
    two as (select *, case when recent_started_at is not null then floor(recent_verified / greatest(60.0, (epoch_us(timestamp '{FIRST_DAY}') - epoch_us(recent_started_at)) / 1e6) * 36000 + 0.5) / 10 else 0.0 end as rate_per_hour,
    greatest(0, state_total - fully_verified) as remaining from one)
    select *, case when state_total > 0 then floor(fully_verified / state_total * 1000 + 0.5) / 10 else 0.0 end as completion_percent,
    case when rate_per_hour > 0 then floor(remaining / rate_per_hour * 10 + 0.5) / 10 end as hours_remaining from two""")  # fmt: skip
def a05_cycle_summary(spark, sf_dir):
    """Counts, rate and time left after the first day."""
    now = F.lit(FIRST_DAY).cast("timestamp")
    log = Tables(spark, sf_dir).events.where(F.col("ts") < now)
    return cycle.summary(cycle.classified(_progress(log)), now)


@query("""select count(*) as total, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type = 'purchase' and value > 50) as large_purchases,
    count(distinct user_id) as users, count(*) filter (where ts >= (select max(ts) from events) - interval 24 hours) as last_day from events""")
def a01_conditional_counts(spark, sf_dir):
    """Several counts in one pass."""
    e = Tables(spark, sf_dir).events
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).agg(  # one row
        F.count("*").alias("total"),
        F.count_if(_is("error")).alias("errors"),
        F.count_if(_is("purchase") & (F.col("value") > 50)).alias("large_purchases"),
        F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")).alias("last_day"),
    )


@query("select event_type, count(*) filter (where value >= 50) as large, count(*) filter (where value < 50) as small from events group by 1")
def a02_filtered_counts(spark, sf_dir):
    """Counts with filters, by kind."""
    Tables(spark, sf_dir).events.createOrReplaceTempView("_events")
    return spark.sql("select event_type, count(*) filter (where value >= 50) as large, count(*) filter (where value < 50) as small from _events group by 1")


@query("""with f as (select user_id, count(*) as failures, max(ts) as last_failure_at from events where event_type = 'error' group by 1) select * from f""")
def a11_failures_by_product(spark, sf_dir):
    """Number and last time of failures."""
    return Tables(spark, sf_dir).events.where(_is("error")).groupBy("user_id").agg(F.count("*").alias("failures"), F.max("ts").alias("last_failure_at"))


@query("""select event_type, coalesce(sum(case when (user_id % 2) = 0 then greatest(0, coalesce(try_cast(nullif(json_extract_string(props, '$.k'), '') as bigint), 0)) else 0 end), 0)::bigint as credits
    from events where ts >= (select max(ts) from events) - interval 20 days group by 1""")
def a13_json_credits(spark, sf_dir):
    """Credits out of JSON details, of one accounting version (even products) only."""
    e = Tables(spark, sf_dir).events
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    n = F.greatest(F.lit(0), F.coalesce(F.nullif(jsons.field(F.col("props"), "$.k"), F.lit("")).try_cast("bigint"), F.lit(0)))
    recent = e.crossJoin(now).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 20 DAYS"))
    return recent.groupBy("event_type").agg(F.coalesce(F.sum(F.when(F.col("user_id") % 2 == 0, n).otherwise(0)), F.lit(0)).cast("long").alias("credits"))


@query("""with d as (select user_id % 7 as domain, count(*) filter (where event_type = 'purchase') as verified, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type = 'view') as skipped from events group by 1)
    select *, case when verified + failed > 0 then floor(verified / (verified + failed) * 100 + 0.5)::bigint end as success_rate from d""")
def a15_success_by_domain(spark, sf_dir):
    """Outcomes and success rate by domain (user_id mod 7)."""
    d = Tables(spark, sf_dir).events.groupBy((F.col("user_id") % 7).alias("domain")).agg(F.count_if(_is("purchase")).alias("verified"), F.count_if(_is("error")).alias("failed"), F.count_if(_is("view")).alias("skipped"))
    tried = F.col("verified") + F.col("failed")
    return d.withColumn("success_rate", F.when(tried > 0, F.floor(F.col("verified") / tried * 100 + 0.5)))


@query("""select coalesce(event_type, 'all') as event_type, coalesce(day, 'all') as day, count(*) as n from (select event_type, strftime(ts, '%Y-%m-%d') as day from events) group by grouping sets ((event_type), (day), ())""")
def a16_facets(spark, sf_dir):
    """Facet counts of two dimensions and the total in one pass."""
    e = Tables(spark, sf_dir).events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    sets = e.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "n")


@query("""select user_id, max(case when event_type = 'purchase' then value end) as most, arg_max(event_type, ts) as last_type, count(*) as events from events group by 1""")
def a21_merged_state(spark, sf_dir):
    """Counters by maximum, fields by the last writer."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max(F.when(_is("purchase"), F.col("value"))).alias("most"), F.max_by("event_type", "ts").alias("last_type"), F.count("*").alias("events"))


@query("""select user_id, least(250, count(*) filter (where event_type = 'error'))::bigint as blocked, coalesce(bool_or(event_type = 'error' and value > 95), false) as fast_skip from events group by 1""")
def a22_blocked_counter(spark, sf_dir):
    """A counter folded in order of time, capped, and a flag that sticks."""
    e = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("log"))
    fold = F.aggregate(
        "log",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("skip")),
        lambda a, x: F.struct(F.least(F.lit(250).cast("long"), a["n"] + F.when(x["event_type"] == "error", 1).otherwise(0)).alias("n"), (a["skip"] | ((x["event_type"] == "error") & (x["value"] > 95))).alias("skip")),
    )
    return e.select("user_id", fold["n"].alias("blocked"), fold["skip"].alias("fast_skip"))


@query("""select event_type, sha256(string_agg(user_id::varchar, chr(10) order by user_id)) as digest, count(*) as users from (select distinct event_type, user_id from events) group by 1""")
def a23_order_free_digest(spark, sf_dir):
    """Digest of a set whatever the order of its rows."""
    ids = F.transform(F.array_sort(F.collect_list("user_id")), lambda x: x.cast("string"))
    return Tables(spark, sf_dir).events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("digest"), F.count("*").alias("users"))


@query("""with b as (select user_id // 10 as batch, count(*) filter (where event_type = 'purchase') as done, count(*) filter (where event_type = 'error') as failed, count(*) as total from events group by 1)
    select *, case when failed = 0 and done > 0 then 'completed' when done = 0 then 'failed' else 'partial' end as status from b""")
def a24_batch_status(spark, sf_dir):
    """A batch's status from its rows' outcomes."""
    b = Tables(spark, sf_dir).events.groupBy(F.floor(F.col("user_id") / 10).alias("batch")).agg(F.count_if(_is("purchase")).alias("done"), F.count_if(_is("error")).alias("failed"), F.count("*").alias("total"))
    return b.withColumn("status", F.when((F.col("failed") == 0) & (F.col("done") > 0), "completed").when(F.col("done") == 0, "failed").otherwise("partial"))


@query(f"{WITH} select least(40, count(*)) as batch from classified where cycle_state = 'verified'")
def a29_capped_batch(spark, sf_dir):
    """How many are fully verified, at most the batch's size."""
    s = cycle.classified(_progress(Tables(spark, sf_dir).events))
    return s.where("cycle_state = 'verified'").agg(F.least(F.lit(40), F.count("*")).alias("batch"))


@query("""select c.c_custkey, c.c_mktsegment from customer c where not exists (select 1 from events e where e.user_id = c.c_custkey and e.event_type = 'error'
    and e.ts >= (select max(ts) from events) - case when c.c_mktsegment = 'BUILDING' then interval 10 days else interval 2 days end)""")
def j04_no_recent_event(spark, sf_dir):
    """Anti-join on a time window whose length depends on the row."""
    t = Tables(spark, sf_dir)
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    c = t.customer.select("c_custkey", "c_mktsegment").crossJoin(now)
    c = c.withColumn("cutoff", F.when(F.col("c_mktsegment") == "BUILDING", F.col("now") - F.expr("INTERVAL 10 DAYS")).otherwise(F.col("now") - F.expr("INTERVAL 2 DAYS")))
    bad = t.events.where(_is("error")).select("user_id", "ts")
    return c.join(bad, (c["c_custkey"] == bad["user_id"]) & (bad["ts"] >= c["cutoff"]), "left_anti").select("c_custkey", "c_mktsegment")


@query("""select c_custkey, c_name from customer c where c_acctbal > 0 and c_name not like '%placeholder%' and exists (select 1 from orders o where o.o_custkey = c.c_custkey)
    and not exists (select 1 from events e where e.user_id = c.c_custkey and e.event_type = 'purchase' and e.ts >= timestamp '2024-01-20')
    and not exists (select 1 from events e where e.user_id = c.c_custkey and e.event_type = 'error' and e.ts >= timestamp '2024-01-25')""")
def p22_eligible_for_sync(spark, sf_dir):
    """Enabled, linked, and neither a recent success nor a recent failure."""
    t = Tables(spark, sf_dir)
    since = lambda kind, day: t.events.where(_is(kind) & (F.col("ts") >= F.lit(day).cast("timestamp"))).select(F.col("user_id").alias("c_custkey"))
    c = t.customer.where((F.col("c_acctbal") > 0) & ~F.col("c_name").contains("placeholder")).select("c_custkey", "c_name")
    linked = c.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return linked.join(since("purchase", "2024-01-20"), "c_custkey", "left_anti").join(since("error", "2024-01-25"), "c_custkey", "left_anti")


@query("""with b as (select user_id, bool_and(value > 1) as priced from events where event_type = 'error' and props like '%"k"%' group by 1)
    select user_id from b where priced and user_id not in (select user_id from events where event_type = 'purchase' and ts >= timestamp '2024-01-28')
    and user_id not in (select user_id from events where event_type = 'click' and ts >= timestamp '2024-01-30')""")
def p38_stored_fallback(spark, sf_dir):
    """Blocked products, priced throughout, outside two windows of other events."""
    t = Tables(spark, sf_dir)
    b = t.events.where(_is("error") & F.col("props").rlike('"k"')).groupBy("user_id").agg(F.bool_and(F.col("value") > 1).alias("priced")).where("priced").select("user_id")
    out = lambda kind, day: t.events.where(_is(kind) & (F.col("ts") >= F.lit(day).cast("timestamp"))).select("user_id")
    return b.join(out("purchase", "2024-01-28"), "user_id", "left_anti").join(out("click", "2024-01-30"), "user_id", "left_anti")


@query("""select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def w04_latest_event(spark, sf_dir):
    """The last event of every product."""
    return cycle.latest(Tables(spark, sf_dir).events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "ts")


@query("""select user_id, event_id, r as rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc)::int as r from events) where r <= 25""")
def w05_last_events(spark, sf_dir):
    """The last 25 events of every product."""
    return cycle.latest(Tables(spark, sf_dir).events, "user_id", "ts", "event_id", 25).select("user_id", "event_id", "rank")


@query("""with h as (select *, max(ts) filter (where event_type = 'purchase') over (partition by user_id) as healthy from events)
    select user_id, count(*) filter (where event_type = 'error' and (healthy is null or ts > healthy)) as failures_since, count(*) filter (where event_type = 'error' and (healthy is null or ts > healthy)) >= 2 as confirmed from h group by 1""")
def w06_failures_since_success(spark, sf_dir):
    """Failures after the last success, and whether they confirm that a source is gone."""
    return cycle.since_last_success(Tables(spark, sf_dir).events, "user_id", "ts", _is("purchase"), _is("error"))


@query("""with w as (select event_id, user_id, epoch_us(ts) as us, count(*) over o as in_window, min(epoch_us(ts)) over o as oldest from events window o as (partition by user_id order by epoch_us(ts) range between 21599999999 preceding and current row))
    select event_id, user_id, in_window, in_window >= 4 as limited, case when in_window >= 4 then oldest + 21600000000 - us else 0 end as wait_us from w""")
def w11_rate_window(spark, sf_dir):
    """Requests in the last six hours, against a limit of four, and the wait."""
    return cycle.within_window(Tables(spark, sf_dir).events, "user_id", "ts", 21600, 4).select("event_id", "user_id", "in_window", "limited", "wait_us")


@query("""select c_custkey from customer where c_custkey not in (select user_id from events where event_type = 'error' and value > 90)""")
def t08_tombstones(spark, sf_dir):
    """Rows without those that failed for good."""
    t = Tables(spark, sf_dir)
    gone = t.events.where(_is("error") & (F.col("value") > 90)).select(F.col("user_id").alias("c_custkey"))
    return t.customer.select("c_custkey").join(gone, "c_custkey", "left_anti")


@query("""select time_bucket(interval 24 hours, ts, timestamp '1970-01-01') as start, event_type, count(*) as n from events group by 1, 2""")
def t11_daily_counts(spark, sf_dir):
    """Counts by window of 24 hours."""
    return Tables(spark, sf_dir).events.groupBy(F.window("ts", "24 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""select user_id, event_id from events where json_extract_string(props, '$.k') = '3'""")
def p07_json_path(spark, sf_dir):
    """A predicate on a JSON path, absent as empty."""
    return Tables(spark, sf_dir).events.where(jsons.field(F.col("props"), "$.k", "") == "3").select("user_id", "event_id")


@query("""select event_id from events where regexp_matches(coalesce(props, ''), '"k"[[:space:]]*:[[:space:]]*7')""")
def p06_json_by_pattern(spark, sf_dir):
    """The same kind of predicate by a pattern over the text."""
    return Tables(spark, sf_dir).events.where(F.coalesce("props", F.lit("")).rlike(r'"k"\s*:\s*7')).select("event_id")


@query("""select case when event_type = 'error' and value > 66 then 'timeout' when event_type = 'error' and value > 33 then 'blocked' when event_type = 'error' then 'missing' else 'other' end as reason, count(*) as n from events group by 1""")
def p17_failure_reasons(spark, sf_dir):
    """Failures by bucket."""
    reason = F.when(_is("error") & (F.col("value") > 66), "timeout").when(_is("error") & (F.col("value") > 33), "blocked").when(_is("error"), "missing").otherwise("other")
    return Tables(spark, sf_dir).events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""with m as (select max(ts) as now from events) select count(*) filter (where event_type = 'view' and ts >= now - interval 1 hour) as running, count(*) filter (where event_type = 'click' and coalesce(ts, now) < now - interval 30 days) as stale,
    count(*) filter (where event_type = 'error' and ts >= now - interval 1 hour) as recent_failed, count(*) filter (where event_type = 'view' and ts >= now - interval 1 hour) + count(*) filter (where event_type = 'error' and ts >= now - interval 1 hour) = 0 as quiet from events, m""")
def p35_queue_quiet(spark, sf_dir):
    """Whether nothing runs, hangs or failed lately."""
    e = Tables(spark, sf_dir).events
    each = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    hour = F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 HOUR")
    running, failed = F.count_if(_is("view") & hour), F.count_if(_is("error") & hour)
    return each.agg(running.alias("running"), F.count_if(_is("click") & (F.coalesce("ts", "now") < F.col("now") - F.expr("INTERVAL 30 DAYS"))).alias("stale"), failed.alias("recent_failed"), (running + failed == 0).alias("quiet"))


@query("""select event_id, case when day(ts) >= 12 then date_trunc('month', ts) + interval 11 days else date_trunc('month', ts) - interval 1 month + interval 11 days end::timestamp as cycle_start, ts - interval 90 minutes as cutoff, date_trunc('day', ts)::timestamp as day_start from events""")
def d01_time_bounds(spark, sf_dir):
    """Start of the billing cycle and of the day, and a cutoff."""
    now = F.col("ts")
    return Tables(spark, sf_dir).events.select("event_id", jsons.cycle_start(now, 12).alias("cycle_start"), jsons.cutoff(now, "90 MINUTES").alias("cutoff"), F.date_trunc("day", now).alias("day_start"))


@query("""with j as (select *, case when event_id % 3 = 0 then ts + interval 4 minutes end as page_at, (select max(ts) from events) as now from events)
    select event_id, coalesce(page_at, ts) as heartbeat, coalesce(page_at, ts) < now - interval 5 minutes as stale from j""")
def d02_heartbeat(spark, sf_dir):
    """A job's last sign of life: its last page, else its start."""
    e = Tables(spark, sf_dir).events
    each = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    page = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"lastPageAt":"'), F.date_format(F.col("ts") + F.expr("INTERVAL 4 MINUTES"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('"}')))
    beat = jsons.heartbeat(page, F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp"))
    return each.select("event_id", beat.alias("heartbeat"), (beat < F.col("now") - F.expr("INTERVAL 5 MINUTES")).alias("stale"))
