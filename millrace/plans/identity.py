"""Further matchers, audits and selections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import money, text, urls
from ..operators import extraction, matching, quality
from .base import Tables, query

SLUG = "lower(replace(p_name, ' ', '-'))"


@query(f"""with s as (select lower(p_name) as t, p_brand, min(p_partkey) as pos, count(distinct p_partkey) as n from part where p_partkey % 2 = 1 group by 1, 2) select p.p_partkey, s.pos from part p join s on s.t = lower(p.p_name) and s.p_brand = p.p_brand where p.p_partkey % 2 = 0 and s.n = 1 and length({SLUG}) > 0""")
def j12_slug_titles(spark, sf_dir):
    """Titles out of URL slugs, with the vendor, that name one row."""
    part = Tables(spark, sf_dir).part
    url = F.concat(F.lit("https://x.ae/buy-"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("/p/1"))
    rows = part.where("p_partkey % 2 = 1").select(urls.slug_title(url).alias("title"), "p_brand", F.col("p_partkey").alias("pos"))
    one = matching.unique_by(rows, ["title", "p_brand"], "pos", ["pos"])
    return part.where("p_partkey % 2 = 0").select("p_partkey", text.title_link(F.col("p_name")).alias("title"), "p_brand").join(one, ["title", "p_brand"]).select("p_partkey", "pos")


@query("""with r as (select p_partkey, p_name, p_brand, 'S' || p_size as sku, p_size || '-' || substr(p_brand, 7) as code from part), a as (select * from r where p_partkey % 2 = 0), b as (select * from r where p_partkey % 2 = 1),
    s as (select a.p_partkey, min(b.p_partkey) as m from a join b using (sku, p_name) group by 1 having count(*) = 1), t as (select a.p_partkey, min(b.p_partkey) as m from a join b using (p_name, p_brand) group by 1 having count(*) = 1), c as (select a.p_partkey, min(b.p_partkey) as m from a join b using (code, p_brand) group by 1 having count(*) = 1)
    select a.p_partkey, case when s.m is not null then 'exact_sku' when t.m is not null then 'exact_title' when c.m is not null then 'source_code' else 'none' end as method, coalesce(s.m, t.m, c.m) as match, coalesce(s.m, t.m, c.m) % 4 = 1 as owner_active from a left join s using (p_partkey) left join t using (p_partkey) left join c using (p_partkey)""")
def j28_reference_cascade(spark, sf_dir):
    """A reference row's product: one by SKU, else one by title, else one by code; and whether its owner is active."""
    n = F.col("p_size").cast("string")
    r = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand", F.concat(F.lit("S"), n).alias("sku"), F.concat_ws("-", n, F.substring("p_brand", 7, 10)).alias("code"))
    a, b = r.where("p_partkey % 2 = 0"), r.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "other")

    def one(name: str, keys: list[str]):
        return a.select("p_partkey", *keys).join(b.select("other", *keys), keys).groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("other").alias(name)).where("n = 1").drop("n")

    out = a.select("p_partkey")
    for name, keys in (("by_sku", ["sku", "p_name"]), ("by_title", ["p_name", "p_brand"]), ("by_code", ["code", "p_brand"])):
        out = out.join(one(name, keys), "p_partkey", "left")
    method = F.when(F.col("by_sku").isNotNull(), "exact_sku").when(F.col("by_title").isNotNull(), "exact_title").when(F.col("by_code").isNotNull(), "source_code").otherwise("none")
    match = F.coalesce("by_sku", "by_title", "by_code")
    return out.select("p_partkey", method.alias("method"), match.alias("match"), (match % 4 == 1).alias("owner_active"))


@query("""with s as (select p_partkey as id, 'W' || (10000 + p_partkey * 7 % 800) as k from part where p_partkey % 2 = 0), r as (select p_partkey as row, 'W' || (10000 + p_partkey * 11 % 800) as k from part where p_partkey % 2 = 1) select id, row from s join r using (k)""")
def j30_identifiers(spark, sf_dir):
    """Rows that share an identifier, out of SKUs on one side and URLs on the other."""
    part, k = Tables(spark, sf_dir).part, F.col("p_partkey")
    sku = F.concat(F.lit("W"), (k * 7 % 800 + 10000).cast("string"), F.lit("-OPTION-2"))
    url = F.concat(F.lit("https://www.next.ae/style/st1/W"), (k * 11 % 800 + 10000).cast("string"), F.lit("?x=1"))
    s = part.where("p_partkey % 2 = 0").select(k.alias("id"), F.explode(urls.sku_identifiers(sku, F.lit("Next"))).alias("key"))
    r = part.where("p_partkey % 2 = 1").select(k.alias("row"), F.explode(urls.identifiers(url)).alias("key"))
    return s.join(r, "key").select("id", "row").distinct()


@query("""with q as (select p.p_partkey, p.p_name || ' ' || p.p_type as title, upper(p.p_brand) || p.p_size as sku, o.p_name || ' ' || o.p_type as other, upper(replace(replace(o.p_brand, '#', ''), ' ', '')) || o.p_size as code from part as p join part as o on o.p_partkey = p.p_partkey - p.p_partkey % 4),
    t as (select *, list_distinct(string_split(lower(title), ' ')) as a, list_distinct(string_split(lower(other), ' ')) as b, upper(replace(sku, '#', '')) as own from q where p_partkey % 3 > 0)
    select p_partkey from t where len(list_intersect(a, b)) >= 0.8 * least(len(a), len(b)) and p_partkey % 2 = 0 and len(a) >= 3 and len(b) >= 3 or p_partkey % 2 = 1 and (contains(own, code) or contains(code, own))""")
def j31_self_evidence(spark, sf_dir):
    """Rows whose one plausible URL, made of another row, their own title or SKU confirms; two URLs confirm nothing."""
    part, k = Tables(spark, sf_dir).part, F.col("p_partkey")
    other = part.select(k.alias("o"), F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type")).alias("slug"), F.concat(text.compact(F.col("p_brand")), F.col("p_size").cast("string")).alias("code"))
    each = part.withColumn("o", k - k % 4).join(other, "o")
    named = F.concat(F.lit("see https://x.ae/en/"), F.when(k % 2 == 0, F.col("slug")).otherwise(F.concat(F.lit("style/st1/"), F.col("code"))))
    mentions = F.when(k % 3 == 0, F.concat(named, F.lit(" "), named, F.lit("x"))).otherwise(F.concat(named, F.lit(" https://cdn.x.ae/en/i.jpg")))
    return matching.self_confirmed(each, "p_partkey", mentions, F.concat_ws(" ", "p_name", "p_type"), F.concat(F.upper("p_brand"), F.col("p_size").cast("string")), lambda u: ~F.contains(u, F.lit("cdn."))).select("p_partkey")


@query("""with r as (select 'u' || (l_partkey // 3) as url, case when l_partkey % 200 < 3 then l_linenumber % 2 + 22 else 22 end as multiplier from lineitem),
    g as (select url, count(distinct multiplier) > 1 as conflict from r group by 1), f as (select 'u' || (p_partkey // 3) as url, count(distinct p_partkey) as products, min(p_partkey) as product from part where p_partkey % 3 = 0 or p_size = 7 group by 1),
    s as (select 'u' || (p_partkey // 3) as url, count(*) as read, count(distinct lower(p_type)) as read_colours, bool_and(p_size > 2) as identified from part where p_size % 3 > 0 group by 1),
    v as (select l_partkey as product, count(*) as there, count(distinct lower(l_returnflag)) as colours, count(*) filter (where l_quantity <= 1) as unmapped, count(*) filter (where l_discount > 0.095) as placeholders from lineitem where l_linenumber = 1 group by 1)
    select url, case when conflict then 'conflict' when coalesce(products, 0) > 1 then 'ambiguous' when products is null then 'missing' when colours > 1 and coalesce(read_colours, 0) <= 1 then 'colour_ambiguity' when identified and read > 1 and coalesce(there, 0) < read or unmapped > 0 or placeholders > 0 then 'rebuild_required' else 'verified' end as status,
    case when not conflict and products = 1 then f.product end as product from g left join f using (url) left join s using (url) left join v on v.product = f.product""")
def j33_reconcile_groups(spark, sf_dir):
    """What may be done about each URL of the sheets: the first that applies of conflict, ambiguity, absence, colours, rebuild."""
    t, k = Tables(spark, sf_dir), F.col("p_partkey")
    url = lambda c: F.concat(F.lit("u"), F.floor(F.col(c) / 3).cast("string")).alias("url")
    rows = t.lineitem.select(url("l_partkey"), F.when(F.col("l_partkey") % 200 < 3, F.col("l_linenumber") % 2 + 22).otherwise(22).alias("multiplier"))
    located = t.part.where((k % 3 == 0) | (F.col("p_size") == 7)).select(url("p_partkey"), k.alias("product"))
    source = t.part.where("p_size % 3 > 0").select(url("p_partkey"), F.col("p_type").alias("colour"), (F.col("p_size") > 2).alias("identified"))
    target = t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("colour"), (F.col("l_quantity") > 1).alias("mapped"), (F.col("l_discount") > 0.095).alias("placeholder"))
    return matching.reconciled(rows, located, source, target)


@query("""select l_orderkey, count(*) as variants, bool_and(abs(floor(l_extendedprice * 22 + 0.5) - (floor(l_extendedprice * 22 + 0.5) + case when l_partkey % 50 = 0 then 1 else 0 end)) < 0.01) as verified from lineitem group by 1""")
def j34_row_audit(spark, sf_dir):
    """Whether all of a product's variants have the price that the rule gives."""
    zero = F.lit(0.0)
    want = money.price_by_rule(F.col("l_extendedprice"), F.lit(22.0), zero, zero, F.lit(".00"), zero, zero)
    has = want + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)
    each = Tables(spark, sf_dir).lineitem.select("l_orderkey", money.money_close(want, has).alias("fine"))
    return each.groupBy("l_orderkey").agg(F.count("*").alias("variants"), F.bool_and("fine").alias("verified"))


@query("""select p_partkey, p_retailprice > 0 and length(p_name) >= 3 and p_size % 4 <> 0 as usable, p_size % 3 = 0 and p_size % 2 = 0 as target from part""")
def p10_usable_records(spark, sf_dir):
    """Cached records that can be used, and rows that price sync may touch."""
    z = F.col("p_size")
    images = F.when(z % 4 != 0, F.array(F.lit("https://x/1.jpg"))).otherwise(F.array().cast("array<string>"))
    usable = quality.valid_price(F.col("p_retailprice")) & (F.length(text.clean(F.col("p_name"))) >= 3) & (F.size(images) > 0)
    target = money.approved_multiplier(F.when(z % 3 == 0, "22"), F.array(F.lit("x"))).isNotNull() & (F.when(z % 2 == 0, "SKU").otherwise("") != "")
    return Tables(spark, sf_dir).part.select("p_partkey", usable.alias("usable"), target.alias("target"))


STATIC = """regexp_matches(html, '<h1|itemprop=["'']name|property=["'']og:title', 'i') and regexp_matches(html, '<img\\b|property=["'']og:image|itemprop=["'']price|data-price|class=["''][^"'']*price', 'i')"""


def page_sources() -> Column:
    """The pages' sources; of five, one also has JSON-LD of a product, one the state of an application, and one is a shell."""
    k = F.col("page_id") % 5
    ld, state = F.lit('<script type="application/ld+json">{"@type": "Product", "name": "x"}</script>'), F.lit('<script id="__NEXT_DATA__" type="application/json">{}</script>')
    return F.when(k == 0, F.concat("html", ld)).when(k == 1, F.concat("html", state)).when(k == 2, F.lit('<html><div id="root"></div></html>')).otherwise(F.col("html"))


@query(f"""with h as (select page_id, page_id % 9 = 0 as shut, page_id % 5 as k, {STATIC} as static from pages)
    select page_id, case when shut then 'manual_review' when k = 0 then 'json_ld' when k = 1 then 'embedded_state' when k = 2 then 'browser_rendering' when static then 'static_html' else 'manual_review' end as strategy,
    case when shut then 20 when k = 0 then 90 when k = 1 then 80 when k = 2 then 45 when static then 70 else 30 end::int as confidence from h""")
def p28_strategies(spark, sf_dir):
    """How each page's source is best read, by all signals that the detector finds in it."""
    best = quality.strategy(extraction.signals(page_sources()), F.col("page_id") % 9 == 0)
    return Tables(spark, sf_dir).pages.select("page_id", best.alias("s")).select("page_id", "s.strategy", F.col("s.confidence").cast("int").alias("confidence"))


@query("""select p_brand, p_partkey, p_name from part where p_size > 20 and p_retailprice > 900 order by p_retailprice desc, p_partkey limit 30""")
def s13_table_scan(spark, sf_dir):
    """A scan with projection, filter, order and limit."""
    return Tables(spark, sf_dir).part.where("p_size > 20 and p_retailprice > 900").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_brand", "p_partkey", "p_name")


@query("""with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as h from pages) select page_id, count(*) as links, count(distinct h) filter (where not regexp_matches(lower(h), '/(cart|login|search|help)')) as kept from l group by 1""")
def s18_category_links(spark, sf_dir):
    """Links of pages, utility ones left out."""
    each = Tables(spark, sf_dir).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("h"))
    kept = ~F.lower("h").rlike("/(cart|login|search|help)")
    return each.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct(F.when(kept, F.col("h"))).alias("kept"))


@query("""select p_partkey % 4 as feed, p_partkey::varchar as sku, lower(p_name) as title, p_size::double as price from part""")
def s09_naive_csv_feed(spark, sf_dir):
    """A comma-separated feed whose first line names the fields."""
    from ..sources import feeds, sheets

    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.lower("p_name"), F.concat(F.lit("AED "), F.col("p_size").cast("string")))
    files = Tables(spark, sf_dir).part.groupBy((F.col("p_partkey") % 4).alias("feed")).agg(F.concat(F.lit("id,name,price\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return feeds.csv_feed(sheets.read_matrix(files), ["feed"]).select("feed", "sku", "title", "price")


@query("""select event_id, user_id, n <= 3 and not (event_type = 'error' and n > 1) as run from (select *, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id) as n from events)""")
def t02_cycle_caps(spark, sf_dir):
    """Rows that a cycle takes: three a key and day, failures only once."""
    n = F.row_number().over(W.Window.partitionBy("user_id", F.date_format("ts", "yyyy-MM-dd")).orderBy("ts", "event_id"))
    return Tables(spark, sf_dir).events.select("event_id", "user_id", ((n <= 3) & ~((F.col("event_type") == "error") & (n > 1))).alias("run"))


@query("""with l as (select *, max(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as put from events) select event_id, put is not null and ts <= put + interval 12 hours as hit from l where event_type = 'view'""")
def t05_cache_lookups(spark, sf_dir):
    """Reads (views) of a cache with a time to live, after writes (purchases)."""
    put = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(W.Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, 0))
    each = Tables(spark, sf_dir).events.withColumn("put", put).where("event_type = 'view'")
    return each.select("event_id", F.coalesce(F.col("ts") <= F.col("put") + F.expr("INTERVAL 12 HOURS"), F.lit(False)).alias("hit"))


@query("""select h as hash from (select sha1('u' || user_id || '|' || printf('%.2f', floor(value)) || '||' || lower(event_type) || '|') as h, event_id from events) group by 1 having min(event_id) >= 100""")
def t01_unseen_rows(spark, sf_dir):
    """Contents that the first hundred rows do not have."""
    from ..functions import jsons

    h = jsons.fingerprint(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.floor("value").cast("double"), F.lit(None).cast("double"), F.col("event_type"), F.lit(""))
    rows = Tables(spark, sf_dir).events.select("event_id", h.alias("hash"))
    return rows.join(rows.where("event_id < 100").select("hash"), "hash", "left_anti").select("hash").distinct()


@query("""select to_json({'id': c_custkey, 'segment': c_mktsegment}) as line from customer where c_acctbal < 0""")
def k10_json_report(spark, sf_dir):
    """A report as JSON lines, written by a sink that shows all of a job's files or none, and read back."""
    from ..sources import paged, shared

    spark.dataSource.register(paged.JsonReport)
    path = f"{shared.folder(spark)}/report-{uuid.uuid4().hex}"
    rows = Tables(spark, sf_dir).customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    rows.write.format("json_report").mode("append").save(path)
    return spark.read.format("json_report").load(path)


@query("""select c_custkey, c_acctbal from customer union all select s_suppkey + 1000000, s_acctbal from supplier""")
def k01_append(spark, sf_dir):
    """Rows added to a table."""
    from ..sources import sinks

    t = Tables(spark, sf_dir)
    return sinks.union_all([t.customer.select("c_custkey", "c_acctbal"), t.supplier.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))])
