"""Queues and scans over the events and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs
from ..sources import paged, shared
from ..streaming import incremental, stateful
from .base import Tables, query

_FLIGHT = """with recursive q as (select event_id, event_type || ' ' || user_id as k, ts, case when event_id % 11 = 0 then null else value * 900 end as seconds from events where event_type in ('view', 'click')),
    o as (select *, row_number() over (partition by k order by ts, event_id) as n from q),
    r as (select k, n, event_id, event_id as job, ts as began, ts + to_microseconds((seconds * 1000000)::bigint) as ends, false as joined from o where n = 1
        union all select o.k, o.n, o.event_id, case when j then r.job else o.event_id end, case when j then r.began else o.ts end, case when j then r.ends else o.ts + to_microseconds((o.seconds * 1000000)::bigint) end, j
        from (select r.*, o as o, o.ts <= r.began + interval 24 hours and (r.ends is null or o.ts < r.ends) as j from r join o on o.k = r.k and o.n = r.n + 1) as r)
    select event_id, job, joined from r"""


def _requests(df):
    key = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    return df.where(F.col("event_type").isin("view", "click")).withColumns({"key": key, "seconds": F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") * 900_000_000) / 1_000_000)})


@query(_FLIGHT)
def t04_single_flight(spark, sf_dir):
    """Requests and the jobs that they begin or join: one at a time for a type and product, while its lock is not stale."""
    return stateful.folded_batch(_requests(Tables(spark, sf_dir).events), "key", "ts", jobs.single_flight(86_400)).select("event_id", "job", "joined")


@query(_FLIGHT)
def t04_streamed_flights(spark, sf_dir):
    """The same with the running job kept as a stream's state."""
    events = Tables(spark, sf_dir).events
    return stateful.replayed(_requests(incremental.read_stream(spark, sf_dir, "events")), events, "key", "ts", jobs.single_flight(86_400), "flights").select("event_id", "job", "joined")


@query("""with m as (select max(ts) as now from events), j as (select event_id as job, case event_type when 'view' then 'SYNC_PRODUCT' when 'click' then 'SYNC_INVENTORY' when 'error' then 'IMPORT' else 'SYNC_PRICE_STOCK' end as type, case when value < 20 then 'pending' when value < 60 then 'running' else 'completed' end as status,
        case when event_id % 5 > 0 then user_id % 40 end as product, ts as created, case when event_id % 4 > 0 then ts + interval 1 minute end as started from events),
    f as (select j.* from j, m where type <> 'IMPORT' and (status = 'pending' or status = 'running' and (started is null or started <= now - interval 600 minutes)) order by created, job limit 400)
    select job, case when type = 'SYNC_PRODUCT' and product is not null and row_number() over (partition by type, product order by created, job) > 1 then 'completed' else 'pending' end as status from f""")
def t04_recovered_jobs(spark, sf_dir):
    """Interrupted jobs, the oldest first, that run again, once a product."""
    e = Tables(spark, sf_dir).events
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    kind = F.when(F.col("event_type") == "view", "SYNC_PRODUCT").when(F.col("event_type") == "click", "SYNC_INVENTORY").when(F.col("event_type") == "error", "IMPORT").otherwise("SYNC_PRICE_STOCK")
    made = e.select(
        F.col("event_id").alias("job"), kind.alias("type"), F.when(F.col("value") < 20, "pending").when(F.col("value") < 60, "running").otherwise("completed").alias("status"),
        F.when(F.col("event_id") % 5 > 0, (F.col("user_id") % 40).cast("string")).alias("product"), F.col("ts").cast("timestamp").alias("created"), F.when(F.col("event_id") % 4 > 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("started"),
    )
    return jobs.recovered(made.crossJoin(F.broadcast(now)), F.col("now"), 600, 400)  # one row


@query("""with l as (select p_partkey as product, 'u' || (p_partkey % 50) as url, p_size % 2 = 0 as active from part where p_size % 7 = 0), s as (select p_brand as vendor, p_name as title, 'u' || (p_partkey % 100) as url from part where p_partkey % 3 = 0),
    n as (select vendor, title, count(distinct url) as urls, min(url) as sheet_url from s group by 1, 2), w as (select url as sheet_url, min(product) as owner from l group by 1),
    e as (select p.p_partkey as product, l.url as own_url, l.active, n.urls, n.sheet_url, w.owner from part as p left join l on l.product = p.p_partkey left join n on n.vendor = p.p_brand and n.title = p.p_name left join w using (sheet_url))
    select product, case when own_url is not null then case when active then 'active' else 'linked' end when urls > 1 or urls = 1 and owner <> product then 'needs_review' when urls = 1 then 'matched' else 'needs_link' end as status,
    case when own_url is not null then 'database' when urls = 1 and owner <> product then 'conflict' when urls > 1 then 'ambiguous' when urls = 1 then 'title_vendor' else 'none' end as method,
    case when own_url is not null then own_url when urls = 1 and coalesce(owner = product, true) then sheet_url end as url, 'second' as scan from e""")
def t03_catalog_job(spark, sf_dir):
    """The index of a catalog after a scan that was stopped at its third page and taken up again; an earlier scan's row is gone."""
    path = f"{shared.folder(spark)}/catalog-job-{uuid.uuid4().hex}"
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand", "p_size")
    part.select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("title")).repartitionByRange(8, "product").sortWithinPartitions("product").write.parquet(f"{path}/catalog")
    links = part.where("p_size % 7 = 0").select(F.col("p_partkey").alias("product"), F.concat(F.lit("u"), (F.col("p_partkey") % 50).cast("string")).alias("url"), (F.col("p_size") % 2 == 0).alias("active"))
    sheet = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("vendor"), F.col("p_name").alias("title"), F.concat(F.lit("u"), (F.col("p_partkey") % 100).cast("string")).alias("url"))
    index = paged.UpsertTable(spark, f"{path}/index", "product long, status string, method string, url string, scan string", ["product"])
    index.upsert(spark.createDataFrame([(-1, "active", "database", "gone", "first"), (1, "needs_link", "none", None, "first")], "product long, status string, method string, url string, scan string"), -1)
    job = jobs.CatalogJob(spark, path, f"{path}/catalog", "product,vendor,title", "product long, vendor string, title string", index, "second")
    for pages in (3, None):
        job.run(lambda df: jobs.judged(df, links, sheet), pages)
    return job.finish(part.count())
