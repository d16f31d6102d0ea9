"""Predicates and rule sets over the warehouse tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from ..functions import money, text, urls
from ..operators import extraction, quality
from .base import Tables, query
from .scalars import HOST, PATH


@query("select p_partkey, p_brand, p_name as title from part")
def p01_projection(spark, sf_dir):
    """Columns, one renamed."""
    return Tables(spark, sf_dir).part.select("p_partkey", "p_brand", F.col("p_name").alias("title"))


@query("""select o_orderkey, case when lower(coalesce(o_orderstatus, '')) = 'p' then 'db_shopify_product_status_draft' when o_orderpriority = '5-LOW' then 'sync_disabled' when o_orderstatus <> 'O' then 'source_not_active' else 'unknown' end as reason from orders""")
def p02_case_bucket(spark, sf_dir):
    """The first reason that applies."""
    s = F.col("o_orderstatus")
    reason = F.when(F.lower(F.coalesce(s, F.lit(""))) == "p", "db_shopify_product_status_draft").when(F.col("o_orderpriority") == "5-LOW", "sync_disabled").when(s != "O", "source_not_active").otherwise("unknown")
    return Tables(spark, sf_dir).orders.select("o_orderkey", reason.alias("reason"))


@query("select page_id from pages where lower(url) like '%example.org%' or lower(url) like '%example.net%'")
def p03_domain_list(spark, sf_dir):
    """URLs of any of some domains."""
    low = F.lower("url")
    return Tables(spark, sf_dir).pages.where(reduce(or_, [low.contains(d) for d in ("example.org", "example.net")])).select("page_id")


@query("""select o_orderkey from orders where contains(lower(o_orderpriority), 'urg') or contains(o_orderkey::varchar, '77') or exists (select 1 from lineitem where l_orderkey = o_orderkey and contains(l_partkey::varchar, '19'))""")
def p04_search_across_relations(spark, sf_dir):
    """A search over a product's own fields and its variants'."""
    t = Tables(spark, sf_dir)
    child = t.lineitem.where(F.col("l_partkey").cast("string").contains("19")).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    own = F.lower("o_orderpriority").contains("urg") | F.col("o_orderkey").cast("string").contains("77")
    return t.orders.join(child, "o_orderkey", "left").where(own | F.coalesce("hit", F.lit(False))).select("o_orderkey")


@query("""select count(*) as total from orders where o_orderstatus in ('O', 'F') and contains(lower(o_orderpriority), 'high') and o_totalprice >= 1000""")
def p05_dynamic_where(spark, sf_dir):
    """Conditions put together from parameters."""
    wanted = {"status": ("O", "F"), "search": "high", "least": 1000}
    parts = [F.col("o_orderstatus").isin(*wanted["status"]), F.lower("o_orderpriority").contains(wanted["search"]), F.col("o_totalprice") >= wanted["least"]]
    return Tables(spark, sf_dir).orders.where(reduce(and_, parts)).agg(F.count("*").alias("total"))


ISSUES = """array_to_string(list_filter([case when length(trim(p_name)) < 3 then 'missing/invalid product title' end, case when p_brand = 'Brand#1' then 'missing supplier name' end, case when p_partkey % 4 = 0 then 'supplier does not match source URL domain' end,
    case when p_size % 5 = 0 then 'missing/invalid currency code' end, case when p_size % 7 = 0 then 'invalid product price' end, case when p_partkey % 3 = 0 then 'product has no variants' end, case when p_partkey % 3 <> 0 and p_size % 7 = 0 then 'variant #2 has invalid price' end,
    case when p_partkey % 3 = 1 then 'duplicate variant SKU detected' end, case when p_size % 2 = 0 then 'duplicate product images detected' end], lambda x: x is not null), '; ')"""


@query(f"select p_partkey, {ISSUES} as issues from part")
def p08_catalog_issues(spark, sf_dir):
    """All that speaks against a record, in order."""
    k, z = F.col("p_partkey"), F.col("p_size")
    none = F.create_map().cast("map<string,string>")
    v = lambda sku, color, price: F.struct(F.lit(sku).alias("sku"), F.lit("").alias("source_id"), F.lit(color).alias("color"), F.lit("").alias("size"), none.alias("options"), price.alias("price"), F.lit("").alias("image_url"))
    two = F.array(v("A", "red", F.lit(5.0)), F.when(k % 3 == 1, v("a", "blue", F.lit(None).cast("double"))).otherwise(v("B", "blue", F.lit(None).cast("double"))))
    variants = F.when(k % 3 != 0, two).otherwise(F.slice(two, 1, 0))
    images = F.when(z % 2 == 0, F.array(F.lit("https://x/1.jpg"), F.lit("https://x/1.jpg"))).otherwise(F.array(F.lit("https://x/1.jpg")))
    found = quality.catalog_issues(
        F.lit("https://www.shop.ae/p/1"), F.col("p_name"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")), k % 4 != 0,
        F.when(z % 5 != 0, "aed").otherwise("aedx"), F.when(z % 7 != 0, F.col("p_retailprice")).otherwise(F.lit(0.0)), F.lit(False), variants, images,
    )
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(found, "; ").alias("issues"))


@query("""select p_partkey, length(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')))) >= 12 and len(list_filter(string_split(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: x <> '')) >= 2 as valid from part""")
def p12_valid_titles(spark, sf_dir):
    """Titles that identify a product."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.valid_title(F.col("p_name"), 12, 2).alias("valid"))


@query("""select p_partkey from part where p_retailprice <= 950 or (p_brand = 'Brand#2' and p_size not in (10, 20)) order by p_retailprice desc, p_partkey limit 20""")
def p14_suspicious(spark, sf_dir):
    """Active records that look wrong, the most expensive first."""
    bad = (F.col("p_retailprice") <= 950) | ((F.col("p_brand") == "Brand#2") & ~F.col("p_size").isin(10, 20))
    return Tables(spark, sf_dir).part.where(bad).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey")


@query("""select p_partkey, p_size % 2 = 0 and not (p_size % 3 = 0) and p_size % 5 = 0 as defer from part""")
def p15_deferral(spark, sf_dir):
    """Rows put off: approved sheet, not linked, creation off."""
    z = F.col("p_size")
    return Tables(spark, sf_dir).part.select("p_partkey", ((z % 2 == 0) & ~(z % 3 == 0) & (z % 5 == 0)).alias("defer"))


@query("""select event_id, case when event_id % 5 = 0 then false when event_id % 5 = 1 then true when event_id % 5 = 2 then true when event_id % 5 = 3 then true else false end as gone from events""")
def p16_source_gone(spark, sf_dir):
    """Errors that mean a source is gone; signs of blocking veto."""
    k = F.col("event_id") % 5
    code = F.when(k == 1, "SOURCE_GONE").otherwise("E")
    status = F.when(k.isin(0, 2), 404).otherwise(500)
    message = F.when(k == 0, "HTTP 403 from Cloudflare").when(k == 3, "product was removed").otherwise("odd")
    return Tables(spark, sf_dir).events.select("event_id", quality.source_gone(code, status, message).alias("gone"))


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 2 = 0 then 'summer_title' end, case when p_size % 3 = 0 then 'summer_product_type' end, case when p_size % 5 = 0 then 'summer_tag' end, case when p_size % 2 = 0 or p_size % 3 = 0 or p_size % 5 = 0 or p_size % 7 = 0 then 'summer_seasonal_category' end], lambda x: x is not null), ',') as reasons from part""")
def p20_season(spark, sf_dir):
    """Why a product counts as seasonal."""
    z = F.col("p_size")
    title = F.when(z % 2 == 0, F.concat("p_name", F.lit(" Summer dress"))).otherwise(F.lit("Plain"))
    tags = F.array(F.when(z % 5 == 0, "summer-sale").otherwise("sale"), F.when(z % 7 == 0, "swim shorts").otherwise("x"))
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(quality.season_reasons(title, F.lit(""), F.when(z % 3 == 0, "summer wear").otherwise("wear"), tags), ",").alias("reasons"))


@query("""with s as (select p_partkey, [p_size, p_size + 1, p_size + 2] as a from part) select p_partkey, array_to_string(case when len(list_filter(a, lambda x: x % 4 = 0)) > 0 then list_filter(a, lambda x: x % 4 = 0) else a end, ',') as kept from s""")
def p21_fallback_filter(spark, sf_dir):
    """The preferred elements, or all where there is none."""
    from ..operators.variants import preferred

    a = F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2)
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(F.transform(preferred(a, lambda x: x % 4 == 0), lambda x: x.cast("string")), ",").alias("kept"))


@query("""select o_orderkey, least(500, greatest(1, floor(coalesce(case when o_orderkey % 3 = 0 then null else o_totalprice / 100 end, 25))))::bigint as n from orders""")
def p23_bounded(spark, sf_dir):
    """Parameters within bounds, with a default."""
    v = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 100)
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.least(F.lit(500), F.greatest(F.lit(1), F.floor(F.coalesce(v, F.lit(25.0))))).cast("long").alias("n"))


@query("""with p as (select page_id, case page_id % 6 when 0 then 'Please verify you are human' when 1 then '<p>Access Denied</p>' when 2 then '<script>access denied</script>' when 3 then 'Please log in' else html end as h, case when page_id % 6 = 4 then 429 else 200 end as st from pages)
    select page_id, case when contains(lower(h), 'captcha') or contains(lower(h), 'verify you are human') then 'CAPTCHA_DETECTED' when page_id % 6 = 3 then 'LOGIN_REQUIRED' when page_id % 6 = 1 then 'ACCESS_DENIED' when st = 429 then 'MANUAL_REVIEW_REQUIRED' end as code from p""")
def p24_restrictions(spark, sf_dir):
    """Why a page must not be read, the gravest reason first."""
    k = F.col("page_id") % 6
    h = F.when(k == 0, "Please verify you are human").when(k == 1, "<p>Access Denied</p>").when(k == 2, "<script>access denied</script>").when(k == 3, "Please log in").otherwise(F.col("html"))
    found = quality.restrictions(h, F.when(k == 4, 429).otherwise(200))
    return Tables(spark, sf_dir).pages.select("page_id", quality.warning_code(found).alias("code"))


@query("""select page_id, case when regexp_matches(html, '(?i)<h1') and regexp_matches(html, '(?i)<img') then true else false end as static, case when regexp_matches(html, '(?i)<h1') and regexp_matches(html, '(?i)<img') then 25 else 0 end + case when regexp_matches(html, '(?i)<img') and not regexp_matches(html, '(?i)<h1') then 5 else 0 end as confidence from pages""")
def p25_signals(spark, sf_dir):
    """What product data a page seems to carry."""
    s = extraction.signals(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", s["static"].alias("static"), money.signal_confidence(s).alias("confidence"))


@query(f"""with p as (select page_id, {PATH} as path from pages), b as (select page_id, greatest(case when starts_with(path, '/en/') then 4 else -1 end, case when starts_with(path, '/') then 1 else -1 end) as allow, greatest(case when starts_with(path, '/en/1') then 5 else -1 end, case when starts_with(path, '/fr') then 3 else -1 end) as disallow from p) select page_id, allow >= disallow as allowed from b""")
def p27_robots_allowed(spark, sf_dir):
    """Paths that robots rules allow."""
    allow, disallow = F.array(F.lit("/en/"), F.lit("/*")), F.array(F.lit("/en/1"), F.lit("/fr*"))
    path = F.coalesce(urls.part(F.col("url"), "PATH"), F.lit(""))
    return Tables(spark, sf_dir).pages.select("page_id", urls.robots_allowed(path, allow, disallow).alias("allowed"))


@query("""select page_id, case when page_id % 5 = 0 then 'blocked' when page_id % 5 = 1 then 'careful' when page_id % 5 = 2 then 'normal' else 'open' end as mode, case when page_id % 5 = 0 then 0 when page_id % 5 = 1 then 4 when page_id % 5 = 2 then 8 else 10 end as rpm from pages""")
def p29_safe_limits(spark, sf_dir):
    """Limits of a source by mode, out of a small dimension."""
    k = F.col("page_id") % 5
    mode = quality.safe_mode(k != 0, k == 1, F.when(k == 2, 50).otherwise(90))
    limits = spark.createDataFrame([(m, r) for m, _, r, _ in quality.LIMITS], "mode string, rpm int")
    return Tables(spark, sf_dir).pages.select("page_id", mode.alias("mode")).join(F.broadcast(limits), "mode").select("page_id", "mode", "rpm")


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 4 = 0 then 'MISSING_TITLE' end, case when p_size % 3 = 0 then 'MISSING_PRICE' end, case when p_size % 5 = 0 then 'MISSING_IMAGES' end, case when p_size % 2 = 0 then 'NO_VARIANTS' end, case when p_size % 3 = 0 then 'PRICE_PARSE_FAILED' end, case when p_size % 3 <> 0 and p_size % 7 = 0 then 'CURRENCY_UNKNOWN' end, case when p_size > 25 then 'LOW_CONFIDENCE' end], lambda x: x is not null), ',') as codes,
    case when p_size % 4 = 0 or p_size % 3 = 0 then 'rejected' when p_size % 5 <> 0 and p_size <= 25 then 'ready' else 'review' end as readiness from part""")
def p31_extraction_warnings(spark, sf_dir):
    """Warnings and readiness of extracted records."""
    z = F.col("p_size")
    title, price = F.when(z % 4 != 0, F.col("p_name")), F.when(z % 3 != 0, F.col("p_retailprice"))
    images, sure = F.when(z % 5 != 0, 2).otherwise(0), F.when(z > 25, 60).otherwise(80)
    codes = quality.extraction_warnings(title, price, images, F.when(z % 2 != 0, 1).otherwise(0), F.lit(0), F.lit("AED ?"), F.when(z % 7 != 0, "AED"), F.array(F.lit("a"), F.lit("b")), sure)
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(codes, ",").alias("codes"), quality.readiness(title, price, images, sure).alias("readiness"))


@query("""with e as (select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 1000000 + event_id) as last, count(*) as n from events group by 1) select user_id, case when last = 'purchase' then 'repaired' when last = 'error' and n > 5 then 'hard' when last = 'error' then 'retry' else 'waiting' end as state from e""")
def p33_repair_state(spark, sf_dir):
    """A decision from the latest event."""
    e = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
    state = F.when(F.col("last") == "purchase", "repaired").when((F.col("last") == "error") & (F.col("n") > 5), "hard").when(F.col("last") == "error", "retry").otherwise("waiting")
    return e.select("user_id", state.alias("state"))


@query("""select o_orderkey, o_orderpriority from orders where contains(lower(o_orderpriority), 'i') and o_orderstatus = 'O' and o_totalprice > 500 order by o_orderkey limit 25 offset 10""")
def p34_faceted_list(spark, sf_dir):
    """A filtered, paged list."""
    o = Tables(spark, sf_dir).orders.where(F.lower("o_orderpriority").contains("i") & (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 500))
    return o.orderBy("o_orderkey").offset(10).limit(25).select("o_orderkey", "o_orderpriority")


@query("""select count(*) as n from orders where o_orderstatus = 'P' and (select count(*) from orders where o_orderstatus = 'P') <= 1000000""")
def p39_safety_stop(spark, sf_dir):
    """A snapshot only if it is not larger than is safe."""
    o = Tables(spark, sf_dir).orders.where("o_orderstatus = 'P'")
    safe = o.agg(F.count("*").alias("n")).where("n <= 1000000").select(F.lit(1).alias("ok"))
    return o.join(F.broadcast(safe), F.lit(True), "left_semi").agg(F.count("*").alias("n"))  # one row


@query(f"""select page_id, {HOST} = 'x' or regexp_matches(lower({PATH}), '/(en|fr)/[0-9]+') and not regexp_matches({HOST}, '^(media|cdn|img)\\.') as plausible from pages""")
def p37_plausible_products(spark, sf_dir):
    """URLs that can be product pages of their host."""
    path, host = F.lower(F.coalesce(urls.part(F.col("url"), "PATH"), F.lit(""))), F.coalesce(urls.host(F.col("url")), F.lit(""))
    return Tables(spark, sf_dir).pages.select("page_id", (path.rlike("/(en|fr)/[0-9]+") & ~host.rlike(r"^(media|cdn|img)\.")).alias("plausible"))
