"""Incremental forms run as streams over whole tables, with what they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..operators import budget
from ..sources import paged, shared
from ..streaming import incremental, stateful
from .base import Tables, query


def _events(spark, sf_dir, key: Column, fold: stateful.Fold, name: str, **columns: Column) -> DataFrame:
    """A fold over the stream of all events, by a key made of their columns."""
    made = lambda df: df.withColumns({"key": key, **columns})
    return stateful.replayed(made(incremental.read_stream(spark, sf_dir, "events")), Tables(spark, sf_dir).events, "key", "ts", fold, name)


@query("""select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2""")
def t11_streamed_counts(spark, sf_dir):
    """Counts by day and kind as a windowed stream leaves them: each window once, when the watermark has passed it."""
    events, replay = Tables(spark, sf_dir).events, stateful.Replay(spark, "counts")
    span = events.agg(F.min("ts").cast("timestamp").alias("first"), F.max("ts").cast("timestamp").alias("last")).first()
    late = int((span["last"] - span["first"]).total_seconds()) + 1 if span["last"] else 0
    stream = replay.closed(incremental.read_stream(spark, sf_dir, "events").select("event_type", "ts"), "event_type", "ts")
    counts = incremental.trailing_counts(stream, "ts", "event_type", late=f"{late} seconds")
    replay.run(counts)
    return replay.close(counts, stateful.beyond(span["last"], late)).where(F.col("event_type") != stateful.CLOSING)


@query("""select e.event_id, count(*) as in_window, count(*) >= 4 as limited from events e join events b on b.user_id = e.user_id and (b.ts < e.ts or b.ts = e.ts and b.event_id <= e.event_id) and b.ts > e.ts - interval 6 hours group by 1""")
def t06_streamed_limits(spark, sf_dir):
    """Requests beyond a sliding limit, with the window kept as a stream's state."""
    return _events(spark, sf_dir, F.col("user_id"), stateful.limit_fold(21600, 4), "limits").select("event_id", "in_window", "limited")


@query("""with w as (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 43199999999 preceding and current row) as n, count(*) filter (where event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as bad from events)
    select event_id, n >= greatest(1, 8 // power(2, least(3, bad))::int) as limited from w""")
def t06_streamed_ratchet(spark, sf_dir):
    """A sliding limit that each restriction halves for good, in order of event time."""
    return _events(spark, sf_dir, F.col("user_id"), stateful.limit_fold(43200, 8, ratchet=True), "ratchet").select("event_id", "limited")


@query("""with h as (select *, max((ts, event_id)) filter (where event_type = 'purchase') over (partition by user_id) as healthy from events)
    select user_id, count(*) filter (where event_type = 'error' and (healthy is null or (ts, event_id) > healthy)) as failures, failures >= 2 as confirmed from h group by 1""")
def t09_streamed_confirmations(spark, sf_dir):
    """Failures since the last success, kept as a stream's state, and which are confirmed by two."""
    found = _events(spark, sf_dir, F.col("user_id"), stateful.confirmation_fold(), "confirmed")
    last = F.struct("us", "event_id")
    return found.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.max_by("failures", last).alias("failures"), F.max_by("confirmed", last).alias("confirmed"))


@query("""with recursive k as (select user_id, event_type, floor(value / 20) as v, ts, event_id, row_number() over (partition by user_id, event_type, floor(value / 20) order by ts, event_id) as n from events),
    r as (select *, ts as taken, true as fresh from k where n = 1
        union all select k.*, case when k.ts > r.taken + interval 48 hours then k.ts else r.taken end, k.ts > r.taken + interval 48 hours from r join k on k.user_id = r.user_id and k.event_type = r.event_type and k.v = r.v and k.n = r.n + 1)
    select event_id from r where fresh""")
def t01_streamed_unseen(spark, sf_dir):
    """Rows whose content was not taken within 48 hours: a changed row comes in anew, and so does one that has expired."""
    row = jsons.fingerprint(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.floor(F.col("value") / 20).cast("double"), F.lit(None).cast("double"), F.col("event_type"), F.lit(""))
    return _events(spark, sf_dir, row, stateful.unseen_fold(48 * 3600), "unseen").select("event_id")


@query("""select e.event_id, exists (select 1 from events as p where p.event_type = 'purchase' and p.user_id = e.user_id and p.event_id % 3 = e.event_id % 3 and (p.ts, p.event_id) < (e.ts, e.event_id) and e.ts <= p.ts + interval 12 hours) as hit from events as e where e.event_type = 'view'""")
def t05_streamed_cache(spark, sf_dir):
    """Reads (views) of users' caches of three entries each, after writes (purchases) that live for twelve hours."""
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "view", "get")
    return _events(spark, sf_dir, F.col("user_id"), stateful.cache_fold(12 * 3600), "cache", op=op, entry=(F.col("event_id") % 3).cast("string")).select("event_id", "hit")


@query()
def t02_streamed_cycles(spark, sf_dir):
    """What daily cycles take of a sheet's items, new or changed ones first and failed ones once more."""
    item = F.concat(F.lit("row "), F.col("user_id").cast("string"))
    columns = {"item": item, "content": F.concat_ws("|", "event_type", F.floor(F.col("value") / 10).cast("string")), "works": F.col("event_type") != "error"}
    found = _events(spark, sf_dir, F.pmod(F.col("user_id"), F.lit(8)), stateful.cycle_fold(86_400, 3, 1), "cycles", **columns)
    return found.withColumnRenamed("key", "sheet")


_BUDGET = """with recursive q as (select event_id, user_id % 4 as pool, ts, greatest(1, floor(value))::bigint as credits, date_trunc('day', ts) as day, date_trunc('month', ts - interval 11 days) as cycle from events where event_type = 'purchase'),
    o as (select *, row_number() over (partition by pool, cycle order by ts, event_id) as n from q),
    r as (select *, 0::bigint as day_used, 0::bigint as cycle_used, credits <= 400 and credits <= 5000 as taken from o where n = 1
        union all select o.*, case when o.day = r.day then r.day_used + case when r.taken then r.credits else 0 end else 0 end as d, r.cycle_used + case when r.taken then r.credits else 0 end as c, d + o.credits <= 400 and c + o.credits <= 5000
        from r join o on o.pool = r.pool and o.cycle = r.cycle and o.n = r.n + 1)
    select event_id, day_used, cycle_used, taken from r"""


@query(_BUDGET)
def t07_budget_reservation(spark, sf_dir):
    """Reservations of credits by pool, while the day's and the billing cycle's limits hold; refused ones use nothing."""
    asked = Tables(spark, sf_dir).events.where(F.col("event_type") == "purchase").withColumn("pool", F.col("user_id") % 4)
    return budget.reserved(asked, "pool", "ts", "event_id", F.col("value"), 400, 5000).select("event_id", "day_used", "cycle_used", "taken")


@query(_BUDGET)
def t07_streamed_budget(spark, sf_dir):
    """The same with the sums kept as a stream's state."""
    stream = incremental.read_stream(spark, sf_dir, "events").where(F.col("event_type") == "purchase").withColumns({"pool": F.col("user_id") % 4, "credits": budget.credits(F.col("value"))})
    return stateful.replayed(stream, Tables(spark, sf_dir).events, "pool", "ts", stateful.budget_fold(400, 5000), "budget").select("event_id", "day_used", "cycle_used", "taken")


@query("""with p as (select p_partkey, p_name, (row_number() over (order by p_partkey) - 1) // 50 as page from part) select page::int as page, count(*) as items, max(p_partkey) as cursor, min(p_name) as title from p group by 1""")
def t03_resumed_pages(spark, sf_dir):
    """A catalog of pages of 50, in order of its cursor, as a stream that stops after two pages and goes on with the third."""
    spark.dataSource.register(paged.PagedStream)
    path = f"{shared.folder(spark)}/pages-{uuid.uuid4().hex}"
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_name")
    part.repartitionByRange(8, "p_partkey").sortWithinPartitions("p_partkey").write.parquet(f"{path}/catalog")
    for until in ("2", None):
        source = spark.readStream.format("paged_stream").schema("p_partkey long, p_name string, page int").options(path=f"{path}/catalog", columns="p_partkey,p_name", page=50)
        stream = (source.option("until", until) if until else source).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/read").awaitTermination()
    read = spark.read.parquet(f"{path}/read")
    return read.groupBy("page").agg(F.count("*").alias("items"), F.max("p_partkey").alias("cursor"), F.min("p_name").alias("title"))


@query("""select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1""")
def k02_streamed_upserts(spark, sf_dir):
    """Each user's last event, upserted batch by batch into a table in buckets."""
    table = paged.UpsertTable(spark, f"{shared.folder(spark)}/upserts-{uuid.uuid4().hex}", "user_id long, event_id long, event_type string", ["user_id"])

    def keep(df: DataFrame, number: int) -> None:
        held = table.rows().join(df.select("user_id").distinct(), "user_id", "left_semi")
        table.upsert(df.unionByName(held), number, ["event_id"])

    stream = incremental.read_stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{table.path}/state").trigger(availableNow=True).start().awaitTermination()
    return table.rows()
