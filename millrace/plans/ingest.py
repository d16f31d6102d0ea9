"""Spreadsheets, feeds, link graphs and sinks, made of the warehouse tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..sources import feeds, sheets, sinks, web
from .base import Tables, query
from .scalars import HOST


def _csv(part, header: str):
    line = F.concat_ws(",", F.concat(F.lit('"https://shop.ae/p/'), F.col("p_partkey").cast("string"), F.lit('"')), (F.col("p_size") % 30).cast("string"), F.concat(F.lit('"a, ""'), F.col("p_type"), F.lit('"""')))
    made = part.groupBy((F.col("p_partkey") % 16).alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    return made.select("sheet", F.concat(F.lit(header), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("text"))


ROWS = "r as (select p_partkey % 16 as sheet, p_partkey, p_size, p_type, row_number() over (partition by p_partkey % 16 order by p_partkey)::int as n from part)"


@query(f"""with {ROWS} select sheet, n + 1 as row_number, 'https://shop.ae/p/' || p_partkey as url, case when p_size % 30 > 0 then (p_size % 30)::double end as price_multiplier, 'a, "' || p_type || '"' as collection from r""")
def s02_headed_sheets(spark, sf_dir):
    """Sheets with a header, roles found by name."""
    matrix = sheets.read_matrix(_csv(Tables(spark, sf_dir).part, "Product URL,Multiplier,Collection\r\n"))
    return sheets.rows_of(matrix, ["sheet"]).select("sheet", "row_number", "url", "price_multiplier", "collection")


@query(f"""with {ROWS} select sheet, n as row_number, 'https://shop.ae/p/' || p_partkey as url, case when p_size % 30 > 0 then (p_size % 30)::double end as price_multiplier, case when p_size % 30 > 0 then 'a, "' || p_type || '"' else '0' end as collection from r""")
def s03_headerless_sheets(spark, sf_dir):
    """Sheets without a header, roles found by what cells look like."""
    matrix = sheets.read_matrix(_csv(Tables(spark, sf_dir).part, ""))
    return sheets.rows_of(matrix, ["sheet"]).select("sheet", "row_number", "url", "price_multiplier", "collection")


@query(f"""with {ROWS} select sheet, n as row_number, 'https://shop.ae/p/' || p_partkey as url, (p_size % 30)::double as price_multiplier from r where p_size % 30 > 0""")
def s04_strict_sheets(spark, sf_dir):
    """Sheets by position, bad rows left out."""
    matrix = sheets.read_matrix(_csv(Tables(spark, sf_dir).part, ""))
    return sheets.strict(matrix).select("sheet", "row_number", "url", "price_multiplier")


@query(f"""with {ROWS} select sheet, count(*) filter (where p_size % 30 > 0) as valid, count(*) filter (where p_size % 30 = 0) as invalid from r group by 1""")
def s05_invalid_rows(spark, sf_dir):
    """Rows with and without a multiplier, with a reason."""
    rows = sheets.split_invalid(sheets.rows_of(sheets.read_matrix(_csv(Tables(spark, sf_dir).part, "")), ["sheet"]))
    return rows.groupBy("sheet").agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("invalid"))


@query("""select 'first' as sheet_name, 0 as priority, count(*) as n from part where p_partkey % 2 = 0 union all select 'second', 1, count(*) from part where p_partkey % 2 = 1""")
def s06_sheet_union(spark, sf_dir):
    """Sheets one after the other with provenance."""
    part = Tables(spark, sf_dir).part
    both = sheets.union_sheets({"first": part.where("p_partkey % 2 = 0").select("p_partkey"), "second": part.where("p_partkey % 2 = 1").select("p_partkey", "p_size")})
    return both.groupBy("sheet_name", "priority").agg(F.count("*").alias("n"))


@query("""select p_partkey, 'https://docs.google.com/spreadsheets/d/Abc_' || p_partkey || '/export?format=csv&gid=' || case when p_size % 3 = 0 then p_size::varchar when p_size % 3 = 1 then (p_size + 1)::varchar else '0' end as export from part""")
def s07_export_urls(spark, sf_dir):
    """Addresses of sheets as those of their exports."""
    z, k = F.col("p_size"), F.col("p_size") % 3
    end = F.when(k == 0, F.concat(F.lit("/edit?gid="), z.cast("string"), F.lit("#gid=9"))).when(k == 1, F.concat(F.lit("/edit#gid="), (z + 1).cast("string"))).otherwise("/edit")
    return Tables(spark, sf_dir).part.select("p_partkey", urls.sheet_export(F.concat(F.lit("https://docs.google.com/spreadsheets/d/Abc_"), F.col("p_partkey").cast("string"), end)).alias("export"))


@query("""select p_partkey % 8 as feed, p_partkey::varchar as sku, lower(p_name) as title, p_size::double as price, 'AED' as currency from part where p_size % 6 <> 0""")
def s10_json_feeds(spark, sf_dir):
    """Records of JSON feeds of four shapes; those without title and SKU go."""
    k = F.col("p_partkey").cast("string")
    bare = F.col("p_size") % 6 == 0
    record = F.struct(F.when(~bare, k).alias("id"), F.when(~bare, F.lower("p_name")).alias("name"), F.concat(F.lit("AED "), F.col("p_size").cast("string")).alias("sale_price"))
    each = Tables(spark, sf_dir).part.groupBy((F.col("p_partkey") % 8).alias("feed")).agg(F.collect_list(record).alias("l"))
    kind = F.col("feed") % 4
    under = lambda name: F.to_json(F.struct(F.col("l").alias(name)))
    files = each.select("feed", F.when(kind == 0, F.to_json("l")).when(kind == 1, under("products")).when(kind == 2, under("items")).otherwise(under("data")).alias("text"))
    return feeds.json_feed(files).select("feed", "sku", "title", "price", "currency")


@query("""select p_partkey % 8 as feed, p_partkey::varchar as sku, p_name as title, p_size::double as price, 'USD' as currency from part""")
def s11_xml_feeds(spark, sf_dir):
    """Records of XML feeds, by pattern."""
    item = F.concat(F.lit("<item id='1'>\n<g:id>"), F.col("p_partkey").cast("string"), F.lit("</g:id><title><![CDATA["), F.col("p_name"), F.lit("]]></title><g:price>$"), F.col("p_size").cast("string"), F.lit("</g:price></item>"))
    files = Tables(spark, sf_dir).part.groupBy((F.col("p_partkey") % 8).alias("feed")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), "\n"), F.lit("</rss>")).alias("text"))
    return feeds.xml_feed(files).select("feed", "sku", "title", "price", "currency")


@query(f"""with recursive p as (select page_id, {HOST} as host from pages), e as (select distinct host as src, (select host from p q where q.page_id = p.page_id * 7 % 13) as dst from p), c(url, depth) as (select host, 0 from p where page_id = 0 union select e.dst, c.depth + 1 from c join e on e.src = c.url where c.depth < 3 and e.dst is not null)
    select url, min(depth)::int as depth from c group by 1""")
def s17_crawl(spark, sf_dir):
    """Breadth-first walk over links between hosts, three steps deep."""
    p = Tables(spark, sf_dir).pages.select("page_id", urls.host(F.col("url")).alias("host"))
    to = p.withColumnsRenamed({"page_id": "to", "host": "dst"})
    edges = p.withColumn("to", F.col("page_id") * 7 % 13).join(to, "to").select(F.col("host").alias("src"), "dst").distinct()
    return web.crawl(edges, p.where("page_id = 0").select(F.col("host").alias("url")), 3, 4000)


@query("""select n_nationkey as site, '/private' || n_nationkey as disallow, case when n_nationkey % 2 = 0 then '/private' || n_nationkey || '/ok' else '' end as allow, 'https://x/' || n_nationkey || '.xml' as sitemap from nation""")
def s19_robots(spark, sf_dir):
    """Rules for all agents out of robots files."""
    k = F.col("n_nationkey").cast("string")
    content = F.concat(F.lit("User-agent: other\nDisallow: /\nUser-Agent: *  # all\nDisallow: /private"), k, F.lit(" # x\r\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Allow: /private"), k, F.lit("/ok\n"))).otherwise("Allow:\n"), F.lit("Sitemap: https://x/"), k, F.lit(".xml\nnonsense"))
    got = web.robots(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("site"), content.alias("text")))
    return got.select("site", F.array_join("disallow", ",").alias("disallow"), F.array_join("allow", ",").alias("allow"), F.array_join("sitemap", ",").alias("sitemap"))


@query("""with l as (select event_id as pos, user_id % 3 as s, user_id as row, event_type from events where event_type <> 'error' and event_id % 11 <> 0) select 's' || s as sheet, row::int as row, arg_max(event_type, pos) as outcome from l group by 1, 2""")
def s20_checkpoint_log(spark, sf_dir):
    """Last outcomes out of a log of JSON lines with broken ones; failures are run again."""
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    line = F.to_json(F.struct(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("sheetName"), F.col("user_id").cast("int").alias("rowNumber"), outcome.alias("outcome")))
    broken = F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line)
    return web.checkpoint_outcomes(Tables(spark, sf_dir).events.select(F.col("event_id").alias("pos"), broken.alias("value")))


@query("""select c_custkey, case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 5 <> 0 union all select c_custkey, c_acctbal + 1 from customer where c_custkey % 4 = 0 and c_custkey % 5 = 0""")
def k02_upsert(spark, sf_dir):
    """New rows in place of old ones of their key."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_acctbal")
    return sinks.upsert(c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 2 = 0 then 'seed' else c_mktsegment end as c_mktsegment from customer""")
def k03_seed(spark, sf_dir):
    """Seeded values fill what is empty and change nothing else."""
    c = Tables(spark, sf_dir).customer
    table = c.select("c_custkey", F.when((F.col("c_custkey") % 3 == 0) | (F.col("c_custkey") % 2 != 0), F.col("c_mktsegment")).alias("c_mktsegment"))
    seeds = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("seed").alias("c_mktsegment"))
    return sinks.seed(table, seeds, ["c_custkey"], ["c_mktsegment"])


@query("""select c_custkey, case when c_acctbal < 0 and c_custkey in (select o_custkey from orders) then 'paused' else 'active' end as status from customer""")
def k04_update_from(spark, sf_dir):
    """Rows with a partner in another table, and a condition, change."""
    t = Tables(spark, sf_dir)
    c = t.customer.select("c_custkey", "c_acctbal", F.lit("active").alias("status"))
    return sinks.updated_from(c, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], {"status": F.lit("paused")}, F.col("c_acctbal") < 0).select("c_custkey", "status")


@query("""select event_id from events where ts >= timestamp '2024-01-15'""")
def k06_seen_in_scan(spark, sf_dir):
    """Rows that the scan has seen stay."""
    return sinks.without_unseen(Tables(spark, sf_dir).events, F.lit("2024-01-15").cast("timestamp"), "ts").select("event_id")


@query("""select 'lineitem' as t, count(*) as n from lineitem where l_orderkey % 10 <> 3 union all select 'orders', count(*) from orders where o_orderkey % 10 <> 3""")
def k07_cascade_delete(spark, sf_dir):
    """A product's rows go from all its tables."""
    t = Tables(spark, sf_dir)
    gone = t.orders.where("o_orderkey % 10 = 3").select("o_orderkey")
    left = sinks.cascade_delete({"orders": t.orders, "lineitem": t.lineitem}, gone, {"orders": "o_orderkey", "lineitem": "l_orderkey"})
    return left["orders"].agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n").union(left["lineitem"].agg(F.count("*").alias("n")).select(F.lit("lineitem"), "n"))


@query("""select c_custkey, c_custkey % 2 = 0 and not (c_custkey % 3 = 0 and c_custkey % 5 = 0) as verified_override, case when c_custkey % 2 = 0 and not (c_custkey % 3 = 0 and c_custkey % 5 = 0) then 'old' when c_custkey % 3 = 0 then 'linked' else 'needs_link' end as match_status,
    case when c_custkey % 2 = 0 and not (c_custkey % 3 = 0 and c_custkey % 5 = 0) then 'manual' when c_custkey % 5 = 0 then 'database' else 'title' end as match_method from customer""")
def k08_override_guard(spark, sf_dir):
    """A verified override stays unless the database links."""
    k = F.col("c_custkey")
    c = Tables(spark, sf_dir).customer
    old = c.select("c_custkey", F.lit("old").alias("match_status"), F.lit("manual").alias("match_method"), (k % 2 == 0).alias("verified_override"))
    new = c.select("c_custkey", F.when(k % 3 == 0, "linked").otherwise("needs_link").alias("match_status"), F.when(k % 5 == 0, "database").otherwise("title").alias("match_method"))
    return sinks.verified_override(old, new, "c_custkey")


@query("""with n as (select count(*) as rows, count(*) filter (where event_type = 'purchase') as i, count(*) filter (where event_type = 'error') as f, count(*) filter (where event_type = 'view') as s from events) select 'r1' as run_id, case when rows = 0 then 'empty' when f = 0 then 'completed' when i = 0 then 'failed' else 'partial' end as status,
    '{"rows":' || rows || ',"imported":' || i || ',"failed":' || f || ',"skipped":' || s || '}' as details from n""")
def k09_run_summary(spark, sf_dir):
    """A run's totals and status."""
    outcome = F.when(F.col("event_type") == "purchase", "imported").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped")
    return sinks.run_summary(Tables(spark, sf_dir).events.select(outcome.alias("outcome")), "r1")
