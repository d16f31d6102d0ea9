"""Queries for single rules of records, each under its own name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import jsons, money, options, text
from ..operators import cycle, extraction, quality
from ..sources import feeds, shared, sheets, sinks, web
from . import identity
from .base import Tables, query


@query("""select c_custkey, '"' || c_name || '", ' || c_mktsegment as first, c_acctbal::varchar as second, c_name || chr(10) || c_mktsegment as third from customer""")
def s01_csv_cells(spark, sf_dir):
    """Cells of CSV texts with quotes, commas and line ends inside; blank rows keep their number."""
    cell = lambda *c: F.concat(F.lit('"'), F.replace(F.concat(*c), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", cell(F.lit('"'), F.col("c_name"), F.lit('", '), F.col("c_mktsegment")), F.col("c_acctbal").cast("string"), cell(F.col("c_name"), F.lit("\n"), F.col("c_mktsegment")))
    files = Tables(spark, sf_dir).customer.select("c_custkey", F.concat(F.lit("k,v\r\n\r\n"), row, F.lit("\r\n,,\r\n")).alias("text"))
    at = lambda i, name: F.get("cells", F.lit(i)).alias(name)
    return sheets.read_matrix(files).where("row_index = 2").select("c_custkey", at(0, "first"), at(1, "second"), at(2, "third"))


@query("""with r as (select o_custkey as feed, case when o_orderstatus = 'F' then '' when o_orderstatus = 'O' then o_orderpriority else 'Order ' || o_orderkey end as title, case when o_orderkey % 3 = 0 then o_orderkey::varchar else '' end as sku, o_totalprice as price from orders)
    select feed, title, sku, round(price, 2) as price, 'AED' as currency from r where title <> '' or sku <> ''""")
def s12_feed_candidates(spark, sf_dir):
    """Feed records with fallbacks of their fields; those with neither title nor SKU go."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    record = {"title": F.when(status == "O", F.concat(F.lit(" "), "o_orderpriority")), "name": F.when(status == "P", F.concat(F.lit("Order  "), key)), "sku": F.lit(""), "id": F.when(F.col("o_orderkey") % 3 == 0, key), "price": F.concat(F.lit("AED "), F.col("o_totalprice").cast("string"))}
    found = feeds.candidates(Tables(spark, sf_dir).orders.withColumn("feed", F.col("o_custkey")), lambda n: record.get(n, F.lit(None).cast("string")), ["feed"])
    return found.select("feed", "title", "sku", "price", "currency")


def _paged(spark, sf_dir, page: int) -> DataFrame:
    """The parts, read page by page through the paged data source, as many as the table has."""
    spark.dataSource.register(web.PagedCatalog)
    part, key = Tables(spark, sf_dir).part.select("p_partkey", "p_name"), F.col("p_partkey").asc_nulls_last()
    path = f"{shared.folder(spark)}/catalog-{uuid.uuid4().hex}.parquet"
    part.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
    total = part.count()
    source = spark.read.format("paged_catalog").options(path=path, total=total, page=page, key="p_partkey", title="p_name")
    return web.complete(shared.written(source.load(), "pages"), total)


@query("""with p as (select p_partkey, p_name, (row_number() over (order by p_partkey) - 1) // 50 as page from part) select page::int as page, count(*) as items, max(p_partkey) as cursor, min(p_name) as title from p group by 1""")
def s14_pages(spark, sf_dir):
    """Pages of 50 through the paged data source, with the cursor to go on from."""
    return _paged(spark, sf_dir, 50).groupBy("page").agg(F.count("*").alias("items"), F.max(F.col("id").cast("long")).alias("cursor"), F.min("title").alias("title"))


@query("""select p_partkey::varchar as id, p_name as title from part""")
def s15_complete_scan(spark, sf_dir):
    """A scan by eight workers' pages that has all that the source names."""
    return _paged(spark, sf_dir, 250).select("id", "title")


@query("""with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer) select c_nationkey as sheet, (n + 1)::int as row_number, case when c_custkey % 4 = 0 then '' else 'https://x.ae/p/' || c_custkey end as url,
    case when c_custkey % 5 = 0 then '' else c_name end as title, c_mktsegment as segment from c""")
def s08_uploaded_workbooks(spark, sf_dir):
    """Workbooks as they are uploaded, one a nation, made of the customers: rows by number, empty cells, the URL's column."""
    k = F.col("c_custkey")
    row = F.array(F.when(k % 5 == 0, "").otherwise(F.col("c_name")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("https://x.ae/p/"), k.cast("string"))), F.col("c_mktsegment"))
    head = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("Title"), F.lit("Product URL"), F.lit("Segment"))).otherwise(F.array(F.lit("Title"), F.lit("Where"), F.lit("Segment")))
    each = Tables(spark, sf_dir).customer.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    files = each.select(F.col("c_nationkey").alias("sheet"), sheets.workbook(F.concat(F.array(head), "rows")).alias("content"))
    cell = lambda i, name: F.get("cells", F.lit(i)).alias(name)
    return sheets.uploaded(files, "sheet").select("sheet", "row_number", "url", cell(0, "title"), cell(2, "segment"))


@query("""select c_custkey as id, c_name as title, c_mktsegment as status from customer""")
def s16_full_scan(spark, sf_dir):
    """Id, title and status of everything."""
    return Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"))


@query("""with e as (select user_id as k, max(ts) + interval 168 hours as expires from events where event_type = 'purchase' group by 1) select k, expires from e where expires > timestamp '2024-02-01' order by expires desc, k limit 40""")
def s21_cache_entries(spark, sf_dir):
    """Live entries of a cache with a time to live, those that expire last kept."""
    put = Tables(spark, sf_dir).events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg((F.max("ts") + F.expr("INTERVAL 168 HOURS")).alias("expires"))
    return put.where(F.col("expires") > F.lit("2024-02-01").cast("timestamp")).orderBy(F.desc("expires"), "k").limit(40)


@query("""select o_orderkey, case when o_orderkey = (select min(o_orderkey) from orders) then 'X' else o_orderstatus end as status from orders""")
def k05_guarded_update(spark, sf_dir):
    """A conditional update that must touch one row."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    first = o.agg(F.min("o_orderkey").alias("k")).first()["k"]  # one value
    return sinks.guarded_update(o, F.col("o_orderkey") == first, {"status": F.lit("X")}, 1)


@query("""select l_orderkey, case when min(l_quantity) in (22, 23, 24) then true else false end and bool_or(l_returnflag = 'R') and case when any_value(o_orderpriority) like '%NOT%' then min(l_linenumber) > 1 else any_value(o_orderpriority) in ('1-URGENT', '2-HIGH') end as target from lineitem join orders on o_orderkey = l_orderkey group by 1""")
def p11_price_stock_target(spark, sf_dir):
    """Approved multiplier, some SKU, and a known sheet or else a row number."""
    t = Tables(spark, sf_dir)
    g = t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("q"), F.collect_set(F.when(F.col("l_returnflag") == "R", "S").otherwise("")).alias("skus"), F.min("l_linenumber").alias("line"))
    o = g.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sheet = F.when(~F.col("o_orderpriority").contains("NOT"), F.col("o_orderpriority"))
    multiplier = money.approved_multiplier(F.col("q").cast("string"), F.array().cast("array<string>"))
    return o.select("l_orderkey", quality.price_stock_target(multiplier, F.col("skus"), sheet, F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("line") - 1).alias("target"))


@query("""select p_partkey, p_size % 2 = 0 and p_retailprice > 0 and length(p_name) > 5 and count(l_orderkey) filter (where l_returnflag = 'R') > 0 and count(l_orderkey) > 0 as usable from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_size, p_retailprice, p_name""")
def p13_stored_usable(spark, sf_dir):
    """A stored product that can stand in: same URL, a title, a price, images and variants."""
    t = Tables(spark, sf_dir)
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("images"), F.count("*").alias("variants"))
    key = F.col("p_partkey").cast("string")
    url, stored = F.concat(F.lit("https://m.x.ae/p/"), key, F.lit("/?utm_a=1")), F.concat(F.lit("https://www.x.ae/p/"), F.when(F.col("p_size") % 2 == 0, key).otherwise(F.concat(key, F.lit("1"))))
    p = t.part.join(n, "p_partkey", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("images", "variants")})
    return p.select("p_partkey", quality.stored_usable(url, stored, F.col("p_name"), F.col("p_retailprice"), F.col("images"), F.col("variants")).alias("usable"))


@query("""select l_orderkey, bool_and(l_returnflag = 'R') as sold_out from lineitem group by 1""")
def p18_all_sold_out(spark, sf_dir):
    """Whether every variant is sold out; never for none."""
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(quality.all_sold_out(F.col("l_returnflag") == "R").alias("sold_out"))


@query("""select l_orderkey, case when bool_or(l_linestatus = 'O' or l_quantity > 45) then 'sellable' else 'not_sellable' end as state from lineitem group by 1""")
def p19_sellability(spark, sf_dir):
    """Sellable if any variant is untracked, may be oversold, or is in stock."""
    tracked, n = F.col("l_linestatus") != "O", F.col("l_quantity")
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(quality.sellability(tracked, n, n > 45).alias("state"))


@query(f"""with h as (select page_id, page_id % 5 as k, {identity.STATIC} as static, contains(url, '/es/') as closed from pages)
    select page_id, array_to_string(list_filter([case when closed then 'ROBOTS_DISALLOWED' end, case when page_id % 9 = 0 then 'RESTRICTED' end, case when k > 1 then 'NO_STRUCTURED_DATA' end, case when k = 2 or k > 2 and not static then 'NO_PRODUCT_DATA' end, case when k = 2 then 'BROWSER_NEEDED' end], lambda x: x is not null), ',') as warnings from h""")
def p30_capability_warnings(spark, sf_dir):
    """Warnings of the pages' reports, by all signals that the detector finds in their source."""
    warnings = quality.capability_warnings(extraction.signals(identity.page_sources()), ~F.coalesce(F.contains("url", F.lit("/es/")), F.lit(False)), F.col("page_id") % 9 == 0)
    return Tables(spark, sf_dir).pages.select("page_id", F.array_join(warnings, ",").alias("warnings"))


@query("""with g as (select p_partkey, any_value(p_name) as name, any_value(p_size) as size, max(l_extendedprice) filter (where l_returnflag <> 'N') as price, count(*) filter (where l_returnflag = 'R') as images from part left join lineitem on l_partkey = p_partkey group by 1)
    select p_partkey, case when price is null then 'rejected' when images > 0 and 20 + 20 + 20 + case when size > 25 then 10 else 0 end >= 70 then 'ready' else 'review' end as readiness from g""")
def p32_readiness(spark, sf_dir):
    """ready, review or rejected, by what the line items give the parts."""
    t = Tables(spark, sf_dir)
    g = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("price"), F.count_if(F.col("l_returnflag") == "R").alias("images"))
    p = t.part.join(g, "p_partkey", "left").withColumn("images", F.coalesce("images", F.lit(0)))
    no = F.lit(False)
    sure = money.confidence({"title": F.col("p_name") != "", "price": F.col("price").isNotNull(), "images": F.col("images") > 0, "description": F.col("p_size") > 25, "variants": no, "json_ld": no, "canonical": no, "identity": no})
    return p.select("p_partkey", quality.readiness(F.col("p_name"), F.col("price"), F.col("images"), sure).alias("readiness"))


@query("""with g as (select l_orderkey, count(distinct l_suppkey) filter (where l_linestatus = 'O') as fine, count(*) as images, bool_or(l_returnflag = 'R') as colored from lineitem group by 1)
    select l_orderkey, array_to_string(list_filter([case when fine < 5 then 'too few images' end, case when fine < images then 'images repeat or are no URLs' end, case when not colored then 'no colour' end], lambda x: x is not null), ',') as issues from g""")
def p36_media_checks(spark, sf_dir):
    """What products lack in images and colours."""
    image = F.concat(F.when(F.col("l_linestatus") == "O", "https://x/").otherwise("x/"), F.col("l_suppkey").cast("string"), F.lit(".jpg"))
    g = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.collect_list(image).alias("images"), F.collect_list(F.when(F.col("l_returnflag") == "R", "red").otherwise(" ")).alias("colors"))
    return g.select("l_orderkey", F.array_join(quality.media_issues(F.col("images"), F.col("colors")), ",").alias("issues"))


@query("""with r as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as n from part) select p_partkey, case when n > 1 then substr('DAB-' || upper(replace(p_name, ' ', '-')), 1, 57) || '-' || upper(substr(sha1(p_partkey::varchar), 1, 6)) else 'DAB-' || upper(replace(p_name, ' ', '-')) end as sku from r""")
def w10_sku_collisions(spark, sf_dir):
    """The first user of a SKU keeps it; later ones get a hash, within 64 characters."""
    base = F.concat(F.lit("DAB-"), text.sku_token(F.col("p_name"), 60))
    n = F.row_number().over(W.Window.partitionBy("p_name").orderBy("p_partkey"))
    return Tables(spark, sf_dir).part.select("p_partkey", F.when(n > 1, F.concat_ws("-", F.substring(base, 1, 57), options.short_hash(F.col("p_partkey").cast("string"), 6))).otherwise(base).alias("sku"))


@query("""select p_partkey, upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) as code, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) as low from part""")
def x02_compact(spark, sf_dir):
    """Letters and digits only, in both cases."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.compact(F.col("p_type")).alias("code"), text.compact_lower(F.col("p_type")).alias("low"))


@query("""select p_partkey, lower(p_name) || ' ' || lower(p_type) as label from part""")
def x03_label(spark, sf_dir):
    """Labels: white space collapsed, lower case."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.label(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  \n"), F.col("p_type"), F.lit(" "))).alias("label"))


@query("""select o_orderkey, case o_custkey % 3 when 0 then o_orderkey when 1 then o_custkey end::int as row from orders""")
def x13_reason_rows(spark, sf_dir):
    """Row numbers out of reasons."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    k = F.col("o_custkey") % 3
    reason = F.when(k == 0, F.concat(F.lit("Row "), key, F.lit(": no price "), who)).when(k == 1, F.concat("o_orderpriority", F.lit(" row #"), who, F.lit(", row 7"))).otherwise(F.concat(F.lit("rows of "), who))
    return Tables(spark, sf_dir).orders.select("o_orderkey", text.row_number_in(reason).alias("row"))


@query("""select p_partkey, substr(p_name || p_name, 1, 12) as cut from part""")
def x14_truncated(spark, sf_dir):
    """Texts cut to a length."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.truncated(F.concat("p_name", "p_name"), 12).alias("cut"))


@query("""select o_orderkey, round(o_totalprice / 22, 4) as source from orders""")
def m07_source_prices(spark, sf_dir):
    """Source prices from shop prices and multipliers."""
    return Tables(spark, sf_dir).orders.select("o_orderkey", money.inferred_source_price(F.col("o_totalprice"), F.lit(22.0)).alias("source"))


@query("""select p_partkey, case when p_partkey % 5 = 0 and p_size in (22, 23, 24) then p_size when p_size + 1 in (22, 23, 24) then p_size + 1 when p_size in (22, 23, 24) then p_size end::int as multiplier from part""")
def m08_multipliers(spark, sf_dir):
    """Approved multipliers as recorded, or out of the first SKU that ends in one."""
    z = F.col("p_size")
    sku = lambda n: F.concat(F.lit("DAB-"), text.sku_token(F.col("p_name"), 20), F.lit("-"), n.cast("string"))
    recorded = F.when(F.col("p_partkey") % 5 == 0, z.cast("string")).otherwise("7")
    return Tables(spark, sf_dir).part.select("p_partkey", money.approved_multiplier(recorded, F.array(F.lit("x-21"), sku(z + 1), sku(z))).alias("multiplier"))


@query("""select l_orderkey, l_linenumber, case when l_extendedprice <= 30000 then 'compare-at price must exceed the price' end as issue from lineitem where l_extendedprice <> 30000""")
def m11_compare_at(spark, sf_dir):
    """Compare-at prices that do not exceed the price."""
    return Tables(spark, sf_dir).lineitem.where("l_extendedprice <> 30000").select("l_orderkey", "l_linenumber", money.compare_at_issue(F.lit(30000.0), F.col("l_extendedprice")).alias("issue"))


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'out_of_stock' when 'A' then 'low_stock' else 'unknown' end as status from lineitem""")
def z10_stock_status(spark, sf_dir):
    """Stock states by availability."""
    r = F.col("l_returnflag")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", options.stock_status(r != "R", F.when(r == "A", "low_stock").otherwise("odd")).alias("status"))


@query("""select c_custkey, c_name || '|' || c_mktsegment || '|' || c_nationkey as listed from customer""")
def n03_lists(spark, sf_dir):
    """Lists written as JSON or plainly."""
    parts = ("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    k = F.col("c_custkey") % 3
    written = F.when(k == 0, F.to_json(F.array(*parts, F.lit(" ")))).when(k == 1, F.concat_ws(", ", *parts)).otherwise(F.concat_ws("|", *parts, F.lit("")))
    return Tables(spark, sf_dir).customer.select("c_custkey", F.array_join(jsons.as_list(written), "|").alias("listed"))


@query("""select p_partkey, least(25, 1 + p_size % 30) as products, p_name as first from part""")
def n05_embedded_nodes(spark, sf_dir):
    """Product-like nodes somewhere inside a state object, as many as the part's size says and 25 at most."""
    nodes = F.transform(F.sequence(F.lit(1), F.col("p_size") % 30 + 1), lambda i: F.when(i % 3 == 0, F.concat(F.lit('{"x":{"name":"n","price":'), i.cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit('{"title":"'), F.col("p_name"), F.lit('","sku":"'), i.cast("string"), F.lit('"}'))))
    state = F.concat(F.lit('<script type="application/json">{"a":['), F.array_join(nodes, ","), F.lit('],"b":{"title":"alone","c":{"deep":1}}}</script>'))
    found = extraction.candidates(Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("page_id"), F.lit("https://x/").alias("url"), state.alias("html"))).where("source = 'embedded'")
    return found.groupBy(F.col("page_id").alias("p_partkey")).agg(F.count("*").cast("int").alias("products"), F.min_by("title", "pos").alias("first"))


@query("""select max(p_partkey) as cursor, count(*) as items from (select p_partkey from part where p_partkey > 100 order by 1 limit 50)""")
def t03_resumed_scan(spark, sf_dir):
    """The page after a stored cursor."""
    return web.page_after(Tables(spark, sf_dir).part, "p_partkey", 100).agg(F.max("p_partkey").alias("cursor"), F.count("*").alias("items"))


@query("""with w as (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 43199999999 preceding and current row) as n, greatest(1, 8 // power(2, least(3, count(*) filter (where event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)))::int) as own from events) select event_id, n >= own as limited from w""")
def t06_ratchet(spark, sf_dir):
    """A sliding limit that each restriction halves for good."""
    e = Tables(spark, sf_dir).events
    before = W.Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, -1)
    bad = F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(before), F.lit(0))
    own = F.greatest(F.lit(1), F.floor(F.lit(8) / F.pow(F.lit(2), F.least(F.lit(3), bad))))
    each = cycle.within_window(e.withColumn("own", own), "user_id", "ts", 43200, 8)
    return each.select("event_id", (F.col("in_window") >= F.col("own")).alias("limited"))


@query("""with h as (select *, max(ts) filter (where event_type = 'signup') over (partition by user_id) as healthy from events) select user_id, count(*) filter (where event_type = 'click' and (healthy is null or ts > healthy)) >= 3 as gone from h group by 1""")
def t09_confirmed_gone(spark, sf_dir):
    """Sources that three checks since the last good one found gone."""
    return cycle.since_last_success(Tables(spark, sf_dir).events, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "click", 5).select("user_id", F.col("confirmed").alias("gone"))


@query("""select event_id // 200 as chunk, count(*) as n from events group by 1""")
def t10_chunks(spark, sf_dir):
    """Rows in chunks of 200."""
    return Tables(spark, sf_dir).events.groupBy(F.floor(F.col("event_id") / 200).alias("chunk")).agg(F.count("*").alias("n"))


_TAG, _HREF = web._TAG.replace("'", "''"), web._HREF.replace("'", "''")
_ADDRESS = """lower(regexp_replace(regexp_extract({0}, '^[^/]*'), ':[0-9]*$', '')) || regexp_replace(regexp_extract({0}, '/.*$'), '/+$', '')"""
_REST = r"regexp_replace(regexp_replace({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', '')"


@query(f"""with recursive p as materialized (select {_ADDRESS.format("r")} as addr, html from (select {_REST.format("url")} as r, html from pages where url is not null)),
    tags as (select addr as src, regexp_extract(unnest(regexp_extract_all(html, '{_TAG}', 0)), '{_HREF}', 1) as href from p where html is not null),
    links as (select src, case when regexp_matches(href, '^(?i)https?://') or href like '//%' then {_ADDRESS.format("h")} when href like '/%' then regexp_extract(src, '^[^/]*') || regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') end as dst
        from (select src, href, {_REST.format("case when href like '//%' then 'http:' || href else href end")} as h from tags)),
    steps as (select addr as dst, string_split(ltrim(regexp_extract(addr, '/.*$'), '/'), '/') as s from p),
    above as (select regexp_extract(dst, '^[^/]*') || '/' || array_to_string(s[1:n], '/') as src, dst from steps, range(1, 100) as t(n) where n < len(s)),
    ways as materialized (select distinct src, dst from (select * from links union all select * from above) where dst is not null and src <> dst and regexp_extract(src, '^[^/]*') = regexp_extract(dst, '^[^/]*')
        and not regexp_matches(dst, '[.,]$') and not regexp_matches(regexp_extract(dst, '/.*$'), '(?i){web.UTILITY}')
        and not (regexp_extract(dst, '^[^/]*') like '%.org' and starts_with(regexp_extract(dst, '/.*$'), '/en') and not starts_with(regexp_extract(dst, '/.*$'), '/en/1'))),
    walk as (select min(addr) as url, 0 as depth from p group by regexp_extract(addr, '^[^/]*') union select w.dst, depth + 1 from walk join ways as w on w.src = walk.url where depth < 4),
    near as (select url, min(depth) as depth, regexp_extract(url, '^[^/]*') as host from walk group by url)
    select url, depth::int as depth, host from near qualify row_number() over (partition by host order by depth, url) <= 12""")
def s18_site_crawl(spark, sf_dir):
    """What a walk over the pages' own links and listings reaches on each host from its first page, a dozen addresses a host."""
    pages = Tables(spark, sf_dir).pages.select("url", "html")
    edges = web.page_links(pages).unionByName(web.listings(pages)).where("src <> dst").distinct()
    at = pages.where(F.col("url").isNotNull()).select(web.address(F.col("url")).alias("url"))
    start = at.groupBy(web.host_part(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    files = start.where(F.col("host").endswith(".org")).select(F.col("host").alias("site"), F.lit("User-agent: bot\nDisallow: /\nUser-agent: *\nDisallow: /en\nAllow: /en/1\n").alias("text"))
    return web.crawl_sites(edges, start, web.robots(files), 4, 12, exclude="[.,]$")


@query("""select p_partkey % 10 as site, count(*) as steps from part group by 1""")
def s18_listing_steps(spark, sf_dir):
    """Steps of a walk over listing pages, by site."""
    part = Tables(spark, sf_dir).part
    edges = part.select(F.col("p_partkey").cast("string").alias("src"), (F.col("p_partkey") + 10).cast("string").alias("dst"))
    start = part.select(F.col("p_partkey").cast("string").alias("url"))
    reached = web.crawl(edges, start, 1, 1 << 30).join(part.select(F.col("p_partkey").cast("string").alias("url")), "url")
    return reached.groupBy((F.col("url").cast("long") % 10).alias("site")).agg(F.count("*").alias("steps"))
