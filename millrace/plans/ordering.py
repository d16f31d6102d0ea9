"""Sorts with limits, windows and dedup over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import urls
from .base import Tables, query
from .scalars import CANON_A, HOST


@query("""select o_orderkey, row_number() over (order by case when o_orderstatus = 'P' then 0 else 1 end, o_orderdate, o_orderkey)::int as pos from orders order by case when o_orderstatus = 'P' then 0 else 1 end, o_orderdate, o_orderkey limit 50""")
def o01_priority_sort(spark, sf_dir):
    """Drafts first, then by age."""
    key = [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), "o_orderdate", "o_orderkey"]
    top = Tables(spark, sf_dir).orders.withColumn("k", key[0]).orderBy("k", "o_orderdate", "o_orderkey").limit(50)
    return top.select("o_orderkey", F.row_number().over(W.Window.orderBy("k", "o_orderdate", "o_orderkey")).alias("pos"))  # 50 rows


@query("""select c_custkey from customer order by (c_acctbal < 0) desc, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') desc, c_acctbal, c_custkey limit 40""")
def o02_boolean_sort(spark, sf_dir):
    """Booleans and the existence of a child as sort keys."""
    t = Tables(spark, sf_dir)
    some = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("open", F.lit(True))
    each = t.customer.join(some, "c_custkey", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    return each.orderBy(F.desc(F.col("c_acctbal") < 0), F.desc("open"), "c_acctbal", "c_custkey").limit(40).select("c_custkey")


@query("""with f as (select user_id, count(*) as n, max(ts) as last from events where event_type = 'error' group by 1)
    select c_custkey from customer left join f on user_id = c_custkey where c_acctbal > 0 order by coalesce(n, 0), case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 3 end, last nulls first, c_custkey limit 30""")
def o03_schedule(spark, sf_dir):
    """Fewest failures first, then by domain rank and last failure; sorted before the cut."""
    t = Tables(spark, sf_dir)
    f = t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rank = F.nullif(F.array_position(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment")), F.lit(0))
    each = t.customer.where("c_acctbal > 0").join(f, "c_custkey", "left").withColumn("rank", F.coalesce(rank, F.lit(3)))
    return each.orderBy(F.coalesce("n", F.lit(0)), "rank", F.asc_nulls_first("last"), "c_custkey").limit(30).select("c_custkey")


@query("""select c_custkey from customer where c_custkey not in (select user_id from events where event_type = 'purchase' and ts >= timestamp '2024-01-30') order by case c_mktsegment when 'BUILDING' then 1 else 2 end, c_acctbal, c_custkey limit 25""")
def o04_after_anti(spark, sf_dir):
    """Rank and age after an anti-join."""
    t = Tables(spark, sf_dir)
    done = t.events.where(F.col("event_type") == "purchase").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp")).select(F.col("user_id").alias("c_custkey"))
    left = t.customer.join(done, "c_custkey", "left_anti")
    return left.orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2), "c_acctbal", "c_custkey").limit(25).select("c_custkey")


@query("""select p_partkey from part order by (p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')) desc, p_partkey limit 300""")
def o05_existing_first(spark, sf_dir):
    """Linked rows first, each kind in its own order."""
    t = Tables(spark, sf_dir)
    linked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("linked", F.lit(1))
    each = t.part.select("p_partkey").join(linked, "p_partkey", "left")
    return each.orderBy(F.desc(F.coalesce("linked", F.lit(0))), "p_partkey").limit(300).select("p_partkey")


@query("""select o_orderkey, (select count(*) from orders where o_totalprice > 1000) as total, 60 < (select count(*) from orders where o_totalprice > 1000) as has_more from orders where o_totalprice > 1000 order by o_totalprice desc, o_orderkey limit 20 offset 40""")
def o06_page(spark, sf_dir):
    """A page of rows with the total and whether more follow."""
    o = Tables(spark, sf_dir).orders.where("o_totalprice > 1000")
    total = F.broadcast(o.agg(F.count("*").alias("total")))
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.crossJoin(total).withColumn("has_more", F.lit(60) < F.col("total"))


@query("""select event_id from events where event_type = 'error' order by ts desc, event_id desc limit 12""")
def o07_recent(spark, sf_dir):
    """The twelve most recent failures."""
    return Tables(spark, sf_dir).events.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(12).select("event_id")


@query(f"""select host, arg_min(url, lpad((case when url like '%/en/%' then 0 else 1 end)::varchar, 1, '0') || lpad(length(url)::varchar, 6, '0') || url) as preferred from (select {HOST} as host, url from pages) group by 1""")
def o08_preferred_url(spark, sf_dir):
    """A host's preferred URL: regional first, then the shortest."""
    rank = F.struct(F.when(F.contains("url", F.lit("/en/")), 0).otherwise(1), F.length("url"), F.col("url"))
    return Tables(spark, sf_dir).pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min_by("url", rank).alias("preferred"))


@query("""select p_partkey, 'b' || p_size || '.jpg' as best from part""")
def o09_best_candidate(spark, sf_dir):
    """The candidate with the greatest descriptor of an image's source set."""
    n = F.col("p_size").cast("string")
    made = F.concat(F.lit("a.jpg 1w, b"), n, F.lit(".jpg 900w , c.jpg 200w,d.jpg"))
    each = F.transform(F.split(made, ","), lambda s, i: F.struct(F.coalesce(F.regexp_extract(s, r"\s(\d+(?:\.\d+)?)[wx]", 1).try_cast("double"), F.lit(0.0)).alias("score"), (-i).alias("pos"), F.split_part(F.trim(s), F.lit(" "), F.lit(1)).alias("url")))
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_max(each)["url"].alias("best"))


@query("""select p_name, count(*) as n, min(p_partkey) as first from part group by 1""")
def o11_vendor_last(spark, sf_dir):
    """Groups in order of first row, one vendor's last."""
    return Tables(spark, sf_dir).part.groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).orderBy(F.col("p_name").startswith("z"), "first")


@query(f"""with c as (select page_id, {CANON_A} as url from pages) select url, min(page_id) as page_id, count(*) - 1 as removed from c group by 1""")
def w01_first_wins(spark, sf_dir):
    """The first page of every canonical URL."""
    p = Tables(spark, sf_dir).pages.select("page_id", urls.canonical_link(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("removed"))


@query("""with k as (select *, case when p_size % 7 = 0 then null else p_brand || '|' || p_name end as k from part) select p_partkey, case when k is not null then first_value(p_partkey) over (partition by k order by p_retailprice desc, p_partkey) end as first_id, k is not null and first_value(p_partkey) over (partition by k order by p_retailprice desc, p_partkey) <> p_partkey as duplicate from k""")
def w03_duplicates(spark, sf_dir):
    """Later rows of a key point to the first; rows without a key never do."""
    k = F.when(F.col("p_size") % 7 != 0, F.concat_ws("|", "p_brand", "p_name"))
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_retailprice", k.alias("k"))
    # rows without a key need no window: they would all land in one partition
    first = F.first("p_partkey").over(W.Window.partitionBy("k").orderBy(F.desc("p_retailprice"), "p_partkey"))
    known = part.where("k is not null").select("p_partkey", first.alias("first_id"))
    none = part.where("k is null").select("p_partkey", F.lit(None).cast("long").alias("first_id"))
    return known.unionByName(none).withColumn("duplicate", F.coalesce(F.col("first_id") != F.col("p_partkey"), F.lit(False)))


@query("""with r as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as r from part) select p_partkey, case when r > 1 then p_name || '-' || (r - 1) else p_name end as key from r""")
def w07_suffixed_keys(spark, sf_dir):
    """Repeated keys get their ordinal."""
    r = F.row_number().over(W.Window.partitionBy("p_name").orderBy("p_partkey"))
    return Tables(spark, sf_dir).part.select("p_partkey", F.when(r > 1, F.concat_ws("-", "p_name", (r - 1).cast("string"))).otherwise(F.col("p_name")).alias("key"))


@query("""with r as (select p_partkey, p_brand, p_name, row_number() over (partition by p_brand order by p_partkey) as r from part), d as (select *, row_number() over (partition by p_name order by r, p_brand) as seen from r) select p_partkey from d where seen = 1 order by r, p_brand limit 100""")
def w08_round_robin(spark, sf_dir):
    """Sheets in turn, each URL once, up to a cap."""
    r = F.row_number().over(W.Window.partitionBy("p_brand").orderBy("p_partkey"))
    each = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_name", r.alias("r"))
    once = each.groupBy("p_name").agg(F.min(F.struct("r", "p_brand", "p_partkey")).alias("x")).select("x.*")
    return once.orderBy("r", "p_brand").limit(100).select("p_partkey")


@query("""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as r from customer where c_acctbal > 0) select c_custkey from r order by r, c_mktsegment limit 60""")
def w13_fair_share(spark, sf_dir):
    """One of each domain per round until the batch is full."""
    r = F.row_number().over(W.Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey"))
    return Tables(spark, sf_dir).customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment", r.alias("r")).where("r <= 60").orderBy("r", "c_mktsegment").limit(60).select("c_custkey")


@query("""with v as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 4 as size, 'SKU-' || (l_partkey % 4) as sku, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as idx from lineitem),
    r as (select *, row_number() over (partition by l_orderkey, sku order by idx) as n, row_number() over (partition by l_orderkey order by size, idx) as c from v)
    select l_orderkey, idx::int as idx, case when n > 1 then sku || '-' || upper(substr(sha1(l_partkey::varchar), 1, 6)) else sku end as sku, c = 1 as canonical from r""")
def w09_canonical_and_collisions(spark, sf_dir):
    """A product's canonical variant, and a hash on every SKU that an earlier variant has."""
    from ..functions import options

    idx = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    v = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey", (F.col("l_partkey") % 4).alias("size"), F.concat(F.lit("SKU-"), (F.col("l_partkey") % 4).cast("string")).alias("sku"), idx.alias("idx"))
    n = F.row_number().over(W.Window.partitionBy("l_orderkey", "sku").orderBy("idx"))
    c = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("size", "idx"))
    suffix = options.short_hash(F.col("l_partkey").cast("string"), 6)
    return v.select("l_orderkey", "idx", F.when(n > 1, F.concat_ws("-", "sku", suffix)).otherwise(F.col("sku")).alias("sku"), (c == 1).alias("canonical"))


@query("""select page_id, pos::int as pos, word from (select page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) as word, generate_subscripts(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), 1) - 1 as pos from pages)""")
def w12_positions(spark, sf_dir):
    """Positions that come from the source."""
    return Tables(spark, sf_dir).pages.select("page_id", F.posexplode(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")).alias("pos", "word"))


@query(f"""select {HOST} as host, count(*) as n from pages group by 1""")
def a27_host_histogram(spark, sf_dir):
    """Pages by host, bad URLs together."""
    return Tables(spark, sf_dir).pages.groupBy(F.coalesce(urls.host(F.col("url")), F.lit("invalid")).alias("host")).agg(F.count("*").alias("n"))
