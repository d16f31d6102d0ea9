"""Scalar functions over whole columns of pages, part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, money, options, text, urls
from .base import Tables, query

HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1))"
SQUEEZE = "lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"
KEPT = f"array_to_string(list_filter(string_split({QUERY}, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_|gclid|fbclid|ref|source)')), '&')"
CANON_A = f"""lower(regexp_replace({SCHEME} || '://' || regexp_replace({HOST}, '^m\\.', 'www.') || case when regexp_replace({PATH}, '/+$', '') = '' and {KEPT} <> '' then '/' else regexp_replace({PATH}, '/+$', '') end
    || case when {KEPT} <> '' then '?' || {KEPT} else '' end, '/$', ''))"""


@query(f"select page_id, {CANON_A} as canonical from pages")
def l01_canonical_link(spark, sf_dir):
    """URLs without fragment, tracking and trailing slashes, in lower case."""
    return Tables(spark, sf_dir).pages.select("page_id", urls.canonical_link(F.col("url")).alias("canonical"))


@query(f"select page_id, {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') as canonical from pages")
def l02_canonical_source(spark, sf_dir):
    """URLs without fragment and query."""
    return Tables(spark, sf_dir).pages.select("page_id", urls.canonical_source(F.col("url")).alias("canonical"))


@query("select page_id, regexp_replace(url, '#.*$', '') as canonical from pages")
def l03_canonical_cache(spark, sf_dir):
    """URLs without fragment."""
    return Tables(spark, sf_dir).pages.select("page_id", urls.canonical_cache(F.col("url")).alias("canonical"))


@query(f"select page_id, {HOST} as host, regexp_replace({HOST}, '^www\\.', '') as domain, {HOST} = 'example.com' or ends_with({HOST}, '.example.com') as on_com from pages")
def l05_hosts(spark, sf_dir):
    """Host, domain and a domain test."""
    u = F.col("url")
    return Tables(spark, sf_dir).pages.select("page_id", urls.host(u).alias("host"), urls.domain(u).alias("domain"), urls.on_domain(u, "example.com").alias("on_com"))


@query(f"""select page_id, case when regexp_matches({PATH}, '(?i)/(de|fr|es|it)(/|$)') then 'EU' else 'GLOBAL' end as region, 'UNKNOWN' as currency, 'SRC' as brand from pages""")
def l06_market(spark, sf_dir):
    """Region, currency and brand code by URL."""
    u = F.col("url")
    region = F.when(urls.region(u).isin("ME", "UK", "US", "GLOBAL"), "GLOBAL").otherwise(urls.region(u))
    return Tables(spark, sf_dir).pages.select("page_id", region.alias("region"), urls.currency(u).alias("currency"), urls.brand_code(u).alias("brand"))


@query("""with s as (select p_partkey, 'https://www.shop.ae/en/buy-' || lower(replace(p_name, ' ', '-')) || '/p/' || replace(p_brand, '#', '') || p_partkey || '?v1=' || p_size || 'x77777' as url from part)
    select p_partkey, upper(regexp_replace(regexp_extract(url, '/p/([^/?#]+)', 1), '[^A-Za-z0-9]', '', 'g')) as code, lower(trim(regexp_replace(regexp_replace(regexp_extract(url, '/en/([^/]+)/p/', 1), '^buy-', ''), '[^A-Za-z0-9]+', ' ', 'g'))) as title,
    upper(regexp_replace(regexp_extract(url, '/p/([^/?#]+)', 1), '[^A-Za-z0-9]', '', 'g')) || ',' || upper(regexp_extract(url, 'v1=(.*)$', 1)) as ids from s""")
def l07_product_codes(spark, sf_dir):
    """Product code, title and identifiers of product URLs made of parts."""
    slug = F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))
    url = F.concat(F.lit("https://www.shop.ae/en/buy-"), slug, F.lit("/p/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey").cast("string"), F.lit("?v1="), F.col("p_size").cast("string"), F.lit("x77777"))
    p = Tables(spark, sf_dir).part.select("p_partkey", url.alias("url"))
    u = F.col("url")
    return p.select("p_partkey", urls.product_code(u).alias("code"), urls.slug_title(u).alias("title"), F.array_join(urls.identifiers(u), ",").alias("ids"))


@query("""select page_id, lower(trim(regexp_replace(regexp_replace(last, '(?i)\\.html?$', ''), '[^A-Za-z0-9]+', ' ', 'g'))) as t from (select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) as last from pages) where not regexp_matches(last, '^-?[0-9]*(\\.html)?$')""")
def l08_slug_titles(spark, sf_dir):
    """Titles from last path segments that are no numbers."""
    each = Tables(spark, sf_dir).pages.select("page_id", urls.last_segment_title(F.col("url")).alias("t"))
    return each.where("t <> ''")


@query("""select page_id, len(list_distinct(regexp_extract_all(html, '(?i)https?://[^\\s<>"'']+'))) as links from pages""")
def l09_urls_in_text(spark, sf_dir):
    """How many URLs a page spells out."""
    return Tables(spark, sf_dir).pages.select("page_id", F.size(urls.urls_in(F.col("html"))).cast("long").alias("links"))


@query(f"""with p as (select page_id, lower({PATH}) as path from pages) select page_id, case when regexp_matches(path, '\\.(jpg|jpeg|png|gif|webp|svg|css|js|pdf|ico)') then 'asset' when regexp_matches(path, '/(cart|checkout|account|login|wishlist|search|privacy|terms|help|track|payment)') then 'ignored'
    when regexp_matches(path, '/products?/|/p/|/shop/|-p-|/item/|/sku/') then 'product' when regexp_matches(path, '/([a-z0-9-]{{4,}}-)?([0-9]{{5,}}|[a-z0-9]{{8,}})(\\.html)?$') then 'product' when regexp_matches(path, '/(category|categories|collections?|departments?|c|shop-by|browse)/') then 'category' else 'page' end as type from p""")
def p26_page_types(spark, sf_dir):
    """What kind of page a URL names."""
    return Tables(spark, sf_dir).pages.select("page_id", urls.page_type(F.col("url"))["type"].alias("type"))


@query("""select p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) as clean, upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) as compact, lower(trim(p_type)) as label, lower(trim(regexp_replace(replace(p_name, '&', ' and '), '[^A-Za-z0-9]+', ' ', 'g'))) as title from part""")
def x01_text_forms(spark, sf_dir):
    """clean, compact, label and title forms of names."""
    n = F.col("p_name")
    return Tables(spark, sf_dir).part.select("p_partkey", text.clean(n).alias("clean"), text.compact(n).alias("compact"), text.label(F.col("p_type")).alias("label"), text.title_catalog(n).alias("title"))


@query("""select p_partkey, contains(' ' || lower(p_name) || ' ', ' ' || lower(split_part(p_name, ' ', 2)) || ' ') as has_word, contains(' ' || lower(p_name) || ' ', ' ' || lower(substr(p_name, 2, 4)) || ' ') as has_piece from part""")
def x04_contains_label(spark, sf_dir):
    """Whole-word containment."""
    n = F.col("p_name")
    return Tables(spark, sf_dir).part.select("p_partkey", text.contains_label(n, F.split_part(n, F.lit(" "), F.lit(2))).alias("has_word"), text.contains_label(n, F.trim(F.substring(n, 2, 4))).alias("has_piece"))


@query("""select p_partkey, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) as base, p_name || ' - Size ' || p_size as long from part""")
def x06_base_titles(spark, sf_dir):
    """Titles without the size at their end."""
    long = F.concat("p_name", F.lit(" - Size "), F.col("p_size").cast("string"))
    return Tables(spark, sf_dir).part.select("p_partkey", text.base_title(long).alias("base"), long.alias("long"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(trim(regexp_replace(p_name || ' ' || p_type, '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda w: length(w) > 1 and w not in ('the', 'with', 'and', 'for', 'size', 'years', 'months', 'mths')))), ' ') as tokens from part""")
def x07_token_sets(spark, sf_dir):
    """Distinct words without stop words."""
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(F.array_sort(text.tokens(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("tokens"))


@query("""with v as (select p_partkey, case p_partkey % 6 when 0 then 'H & M' when 1 then 'M&S' when 2 then 'Carter''s' when 3 then 'Max Fashion' when 4 then 'nxt' else p_brand end as v from part), k as (select *, upper(regexp_replace(v, '[^A-Za-z0-9]+', '', 'g')) as k from v)
    select p_partkey, case when k in ('NXT', 'NEXT') then 'NEXT' when k in ('HM', 'HANDM') then 'HM' when k in ('MAX', 'MAXFASHION') then 'MAX' when k in ('MNS', 'MS') then 'MARKSANDSPENCER' when starts_with(k, 'CARTER') then 'CARTERS' else k end as vendor from k""")
def x08_vendors(spark, sf_dir):
    """Vendors by one name each."""
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, "H & M").when(k == 1, "M&S").when(k == 2, "Carter's").when(k == 3, "Max Fashion").when(k == 4, "nxt").otherwise(F.col("p_brand"))
    return Tables(spark, sf_dir).part.select("p_partkey", text.vendor_catalog(v).alias("vendor"))


@query("""select p_partkey, substr(trim(regexp_replace(upper(p_name || '--' || p_type), '[^A-Z0-9]+', '-', 'g'), '-'), 1, 24) as token from part""")
def x09_sku_tokens(spark, sf_dir):
    """SKU tokens."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.sku_token(F.concat_ws("--", "p_name", "p_type")).alias("token"))


@query("""select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as visible, length(html) - length(replace(html, '&amp;', '&')) as entities from pages""")
def x10_visible_text(spark, sf_dir):
    """Length of the visible text, and of what decoding would save."""
    h = F.col("html")
    return Tables(spark, sf_dir).pages.select("page_id", F.length(text.visible_text(h)).cast("long").alias("visible"), (F.length(h) - F.length(F.regexp_replace(h, "&amp;", "&"))).cast("long").alias("entities"))


@query("""select l_orderkey, l_linenumber, floor(l_extendedprice * 2.5 + 10 + l_extendedprice * 5 / 100) + 0.99 as price_99, case when floor(l_extendedprice * 2 + 0.5) < 3000 then 3000.0 when floor(l_extendedprice * 2 + 0.5) > 90000 then 90000.0 else floor(l_extendedprice * 2 + 0.5) end as price_00 from lineitem""")
def m03_prices(spark, sf_dir):
    """Prices by two rules: to .99, and whole with bounds."""
    b, zero = F.col("l_extendedprice"), F.lit(0.0)
    up = money.price_by_rule(b, F.lit(2.5), F.lit(10.0), F.lit(5.0), F.lit(".99"), zero, zero)
    whole = money.price_by_rule(b, F.lit(2.0), zero, zero, F.lit(".00"), F.lit(3000.0), F.lit(90000.0))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", up.alias("price_99"), whole.alias("price_00"))


@query("""select l_orderkey, l_linenumber, l_extendedprice as amount, case l_linenumber % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'AED' end as currency from lineitem""")
def m01_localized_prices(spark, sf_dir):
    """Amount and currency read back from prices written four ways."""
    whole, cents = F.floor("l_extendedprice"), F.lpad(F.round((F.col("l_extendedprice") - F.floor("l_extendedprice")) * 100).cast("int").cast("string"), 2, "0")
    en, de = F.concat(F.format_number(whole, 0), F.lit("."), cents), F.concat(F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), cents)
    k = F.col("l_linenumber") % 4
    arabic = F.translate(F.concat(whole.cast("string"), F.lit("."), cents), "0123456789.", "٠١٢٣٤٥٦٧٨٩٫")
    written = F.when(k == 0, F.concat(F.lit("$"), en)).when(k == 1, F.concat(F.lit("€ "), de)).when(k == 2, F.concat(arabic, F.lit(" د.إ"))).otherwise(en)
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", money.localized_number(written).alias("amount"), money.currency(written).alias("currency"))


@query("""select o_orderkey, least(o_totalprice, o_totalprice * 1.1) as low, greatest(o_totalprice, o_totalprice * 1.1) as high, abs(o_totalprice - round(o_totalprice, 1)) < 0.01 as close, round(o_totalprice / 23, 4) as source from orders""")
def m05_ranges_and_tolerance(spark, sf_dir):
    """Bounds of a written range, equality within a cent, and the price before a multiplier."""
    p = F.col("o_totalprice")
    return Tables(spark, sf_dir).orders.select("o_orderkey", F.least(p, p * 1.1).alias("low"), F.greatest(p, p * 1.1).alias("high"), money.money_close(p, F.round(p, 1)).alias("close"), money.inferred_source_price(p, F.lit(23.0)).alias("source"))


@query("""select p_partkey, case when p_size % 3 = 0 then 0 when p_size % 3 = 1 then p_size else 10 end as quantity, case when p_size % 4 = 0 then 22 when p_size % 4 = 1 then 24 end as multiplier from part""")
def m09_quantities(spark, sf_dir):
    """Stock and approved multiplier from what a record says."""
    k = F.col("p_size") % 3
    status = F.when(k == 0, "sold_out").when(k == 1, "low_stock").otherwise("in_stock")
    explicit = F.when(k == 1, F.col("p_size").cast("double"))
    m = F.col("p_size") % 4
    recorded = F.when(m == 0, "22").when(m == 1, "7").otherwise("9")
    skus = F.array(F.lit("x"), F.when(m == 1, F.lit("DAB-NXT-A-ONE-24")).otherwise("DAB-NXT-A-ONE-1"))
    return Tables(spark, sf_dir).part.select("p_partkey", money.quantity(status, explicit).alias("quantity"), money.approved_multiplier(recorded, skus).alias("multiplier"))


@query("""with s as (select p_partkey, case p_size % 5 when 0 then p_size || '-' || (p_size + 3) || ' months' when 1 then p_size || ' Years' when 2 then 'EU ' || p_size || ' / UK ' || (p_size // 2) when 3 then 'One Size' else 'Default Title' end as raw from part)
    select p_partkey, case when raw like '%months' then upper(regexp_replace(raw, ' months', '')) || 'M' when raw like '%Years' then regexp_extract(raw, '[0-9]+') || 'Y' when raw like 'EU%' then 'EU-' || regexp_extract(raw, 'EU ([0-9]+)', 1) || '-UK-' || regexp_extract(raw, 'UK ([0-9]+)', 1) when raw = 'One Size' then 'ONE' end as token,
    case when raw like '%months' then regexp_extract(raw, '^[0-9]+')::double when raw like '%Years' then regexp_extract(raw, '^[0-9]+')::double * 12 when raw like 'EU%' then 1000 + regexp_extract(raw, 'EU ([0-9]+)', 1)::double when raw = 'One Size' then 5000.0 else 1e308 end as rank from s""")
def z01_size_tokens(spark, sf_dir):
    """Sizes as tokens, and their rank."""
    z, k = F.col("p_size"), F.col("p_size") % 5
    n = z.cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit("-"), (z + 3).cast("string"), F.lit(" months"))).when(k == 1, F.concat(n, F.lit(" Years"))).when(k == 2, F.concat(F.lit("EU "), n, F.lit(" / UK "), F.floor(z / 2).cast("string"))).when(k == 3, "One Size").otherwise("Default Title")
    token = options.size_token(raw)
    rank = options.size_rank_strict(token)
    return Tables(spark, sf_dir).part.select("p_partkey", token.alias("token"), F.when(rank == float("inf"), 1e308).otherwise(rank).alias("rank"))


@query("""select p_partkey, 'DAB-NXT-' || case when length(c) <= 3 then c else substr(c, 1, length(c) - 3) || '-' || substr(c, length(c) - 2) end || '-' || p_size || '-22' as sku from (select *, upper(regexp_replace(p_brand || p_partkey, '[^A-Za-z0-9]', '', 'g')) as c from part)""")
def z06_skus(spark, sf_dir):
    """Deterministic SKUs."""
    code = options.bounded_code(F.concat("p_brand", F.col("p_partkey").cast("string")), F.lit("x"))
    return Tables(spark, sf_dir).part.select("p_partkey", options.base_sku(F.lit("NXT"), code, F.col("p_size").cast("string"), F.lit(22)).alias("sku"))


@query("""select p_partkey, 'brand=' || lower(p_brand) || '|size=' || p_size || '|type=' || lower(p_type) as key from part""")
def z04_option_keys(spark, sf_dir):
    """Option maps as keys, whatever the order of their names."""
    m = F.create_map(F.lit("Type"), F.col("p_type"), F.lit("Size"), F.col("p_size").cast("string"), F.lit("Brand"), F.col("p_brand"))
    return Tables(spark, sf_dir).part.select("p_partkey", options.option_key(m).alias("key"))


@query("""select p_partkey, count(s) as sizes, max(s) as last from part left join (select * from (values (0, 1, 1), (0, 3, 2), (3, 6, 3), (6, 9, 4), (9, 12, 5), (12, 18, 6), (18, 24, 7), (24, 36, 8), (36, 48, 9), (48, 60, 10), (60, 72, 11), (72, 84, 12), (84, 96, 13), (96, 108, 14), (108, 120, 15), (120, 132, 16), (132, 144, 17)) t(lo, hi, s)) on lo >= p_size and hi <= (p_size % 12 + 1) * 12 group by 1""")
def z08_size_ladders(spark, sf_dir):
    """Sizes within the ages of a title: how many, and which comes last."""
    title = F.concat(F.lit("Romper ("), F.col("p_size").cast("string"), F.lit("mths - "), (F.col("p_size") % 12 + 1).cast("string"), F.lit("yrs)"))
    ladder = options.size_ladder(title)
    names = F.array(*[F.lit(n) for _, _, n in options.LADDER])
    last = F.nullif(F.array_position(names, F.coalesce(F.try_element_at(ladder, F.lit(-1)), F.lit(""))), F.lit(0))
    return Tables(spark, sf_dir).part.select("p_partkey", F.size(ladder).cast("long").alias("sizes"), last.cast("int").alias("last"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, sha1('https://x/' || event_id || '|' || printf('%.2f', floor(value)) || '||' || lower(event_type) || '|' || 'S' || user_id) as hash from events""")
def n06_fingerprints(spark, sf_dir):
    """JSON fields, and fingerprints of rows."""
    url, sku = F.concat(F.lit("https://x/"), F.col("event_id").cast("string")), F.concat(F.lit(" s"), F.col("user_id").cast("string"))
    h = jsons.fingerprint(url, F.floor("value").cast("double"), F.lit(None).cast("double"), F.upper("event_type"), sku)
    return Tables(spark, sf_dir).events.select("event_id", F.try_variant_get(jsons.parsed(F.col("props")), "$.k", "bigint").alias("k"), h.alias("hash"))


@query("""select event_id, '{"a":"' || user_id || '","k":"' || event_id || '"}' as merged from events""")
def n02_merged_json(spark, sf_dir):
    """Two JSON objects as one; nulls of the new one change nothing."""
    old = F.concat(F.lit('{"k":"old","a":"'), F.col("user_id").cast("string"), F.lit('"}'))
    new = F.concat(F.lit('{"k":"'), F.col("event_id").cast("string"), F.lit('","a":null}'))
    return Tables(spark, sf_dir).events.select("event_id", jsons.merged(old, new).alias("merged"))
