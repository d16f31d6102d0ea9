"""The rest of the scalar functions, on texts made of the tables' values; the SQL computes what must come out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsons, money, options, text, urls
from ..operators import extraction, nested
from .base import Tables, query


def _pick(values: list[str], key: str = "p_partkey") -> Column:
    """The values in turn."""
    return F.array(*map(F.lit, values))[(F.col(key) % len(values)).cast("int")]


def _by(n: Column, *values: Column) -> Column:
    """The n-th of columns, from 0."""
    out = F.lit(None)
    for i in range(len(values) - 1, -1, -1):
        out = F.when(n == i, values[i]).otherwise(out)
    return out


@query("""select p_partkey, case p_size % 4 when 0 then p_retailprice + p_size when 1 then p_retailprice when 2 then p_size else 0 end::double as most, p_size::double as least,
case p_partkey % 4 when 0 then p_size + 0.5 when 1 then p_retailprice when 2 then null else null end::double as sheet, case when p_size % 2 = 0 then p_size / 100.0 else p_retailprice end::double as cents from part""")
def m02_simple_prices(spark, sf_dir):
    """Ranges, sheet cells and prices in cents."""
    z, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    grouped = F.format_number("p_retailprice", 2)
    text = _by(F.col("p_size") % 4, F.concat(F.lit("AED"), F.format_number(F.col("p_retailprice") + F.col("p_size"), 2), F.lit(" - AED"), z), F.concat(F.lit("from "), grouped), F.concat(z, F.lit(" only")), F.lit("ask"))
    sheet = _by(F.col("p_partkey") % 4, F.concat(z, F.lit(",5")), F.concat(F.lit("AED "), price), F.concat(F.lit("-"), z), F.lit(""))
    cents = F.when(F.col("p_size") % 2 == 0, z).otherwise(F.concat(F.lit("EGP "), grouped))
    least = money.price_range(F.concat(z, F.lit(" to "), F.format_number(F.col("p_retailprice") + 100, 1)))["min"]
    return Tables(spark, sf_dir).part.select("p_partkey", money.price_range(text)["max"].alias("most"), least.alias("least"), money.sheet_price(sheet).alias("sheet"), money.cents_price(cents).alias("cents"))


@query("""with c as (select c_custkey, case c_nationkey % 6 when 0 then 'EGP' when 1 then 'USD' when 2 then 'GBP' when 3 then 'TRY' when 4 then 'MXN' end as c, c_acctbal > 0 as named from customer)
select c_custkey, case when not named or c is null then 'USD' else c end as currency from c""")
def m04_regional_currency(spark, sf_dir):
    """Currencies in the regional order of signals, of amounts as the accounts have them."""
    amount = F.format_number(F.abs("c_acctbal"), 2)
    signal = _by(F.col("c_nationkey") % 6, F.concat(F.lit("EGP "), amount), F.concat(amount, F.lit(" USD")), F.concat(F.lit("£"), amount), F.concat(amount, F.lit(" TL")), F.concat(F.lit("MXN "), amount), amount)
    return Tables(spark, sf_dir).customer.select("c_custkey", money.currency_regional(F.when(F.col("c_acctbal") > 0, signal).otherwise(amount)).alias("currency"))


@query("""select c_custkey, case c_custkey % 5 when 0 then case when c_acctbal > 0 then c_acctbal end when 1 then c_custkey * 1000.0 when 2 then nullif(c_custkey, 0)::double end::double as n from customer""")
def m06_positive_numbers(spark, sf_dir):
    """Texts as positive numbers: balances of either sign, powers of ten, hexadecimal, words and blanks."""
    k = F.col("c_custkey")
    text = _by(k % 5, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" ")), F.concat(k.cast("string"), F.lit("e3")), F.concat(F.lit("0x"), F.hex(k)), F.col("c_name"), F.lit("  "))
    return Tables(spark, sf_dir).customer.select("c_custkey", money.positive(text).alias("n"))


@query("select p_partkey, case when p_size % 2 = 0 then 'compare-at price must exceed the price' end as issue, case when p_size % 3 = 0 then 95 when p_size % 3 = 1 then 40 else 0 end + 5 as confidence from part")
def m10_scores_and_compare_at(spark, sf_dir):
    """Confidence of records, and compare-at prices that are too low."""
    k = F.col("p_size") % 3
    has = {"title": k < 2, "price": k < 2, "images": k == 0, "description": k == 0, "variants": k == 0, "json_ld": k == 0, "canonical": k == 0, "identity": F.lit(True)}
    issue = money.compare_at_issue(F.lit(10.0), F.when(F.col("p_size") % 2 == 0, 10.0).otherwise(12.0))
    return Tables(spark, sf_dir).part.select("p_partkey", issue.alias("issue"), money.confidence(has).alias("confidence"))


@query("""select p_partkey, p_partkey % 6 < 3 or p_partkey % 6 = 5 and p_type in ('SMALL', 'MEDIUM', 'LARGE') as size,
case p_partkey % 3 when 0 then p_size % 2 = 0 when 1 then true else false end as is_default from part""")
def z02_option_predicates(spark, sf_dir):
    """What looks like a size, and what chooses nothing."""
    z = F.col("p_size").cast("string")
    sizes = _by(F.col("p_partkey") % 6, F.concat(z, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(" months")), F.concat(F.lit("EU "), z), F.concat(z, F.lit(" cm")), F.col("p_name"), F.concat(F.lit("Baby Girl "), z, F.lit(" months")), F.col("p_type"))
    defaults = _by(F.col("p_partkey") % 3, F.when(F.col("p_size") % 2 == 0, "Default Title").otherwise(F.col("p_name")), F.lit("Choose a size"), F.concat(z, F.lit(" sizes")))
    return Tables(spark, sf_dir).part.select("p_partkey", options.looks_like_size(sizes).alias("size"), options.is_default(defaults).alias("is_default"))


@query("""select p_partkey, case p_partkey % 4 when 0 then printf('#%02X%02X%02X', p_size, p_partkey % 256, least(255, 5 * p_size + 40)) when 1 then printf('#%02X%02X%02X', p_size, p_size, p_partkey % 256) when 2 then '' else printf('#%X%X%X%X%X%X', p_size % 16, p_size % 16, p_partkey % 16, p_partkey % 16, 10, 10) end as hex from part""")
def z03_swatches(spark, sf_dir):
    """Colours as #RRGGBB: channels of all values, hexadecimal in both lengths, and transparent ones."""
    z, k = F.col("p_size"), F.col("p_partkey")
    text = _by(k % 4, F.format_string("rgb(%d, %d, %d)", z, k % 256, 5 * z + 40), F.format_string("#%02x%02x%02x", z, z, k % 256), F.format_string("rgba(%d,1,1,0)", z), F.format_string("#%x%xa", z % 16, k % 16))
    return Tables(spark, sf_dir).part.select("p_partkey", options.hex_color(text).alias("hex"))


_NAMES = {"A": "Fit", "R": "Colour", "N": "Size", "O": "Length", "F": "Color"}


@query("""with n as (select l_orderkey, case when l_linenumber % 2 = 0 then case l_linestatus when 'O' then 'Length' else 'Color' end else case l_returnflag when 'A' then 'Fit' when 'R' then 'Color' else 'Size' end end as name, l_linenumber as i, l_partkey, l_suppkey from lineitem),
    f as (select l_orderkey, name, min((i, l_partkey, l_suppkey)) as first from n group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by case name when 'Color' then 0 when 'Size' then 1 else 2 end, first) as k from f)
    select l_orderkey, string_agg(name, ',' order by k) as names from r where k <= 3 group by 1""")
def z05_option_names(spark, sf_dir):
    """Option names of orders' lines in the shop's order."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag"))
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[sign]
    each = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name")))).alias("n"))
    return each.select("l_orderkey", F.array_join(options.option_names(F.transform("n", lambda x: x["name"])), ",").alias("names"))


@query("""with v as (select distinct p_size, case when p_partkey % 3 = 0 then p_name else split_part(p_name, ' ', 1) end as value from part), t as (select p_partkey, p_size, p_name || '-' || p_type as title, ' ' || lower(p_name || ' ' || p_type) || ' ' as words from part),
    m as (select p_partkey, value, row_number() over (partition by p_partkey order by length(value) desc, value) as k from t join v using (p_size) where contains(words, ' ' || lower(value) || ' '))
    select t.p_partkey, m.value from t left join m on m.p_partkey = t.p_partkey and m.k = 1""")
def z07_value_from_title(spark, sf_dir):
    """The longest of the values that parts of one size have, words and pairs of them, that a title names."""
    part = Tables(spark, sf_dir).part
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    values = part.groupBy("p_size").agg(F.collect_set(value).alias("values"))
    return part.join(values, "p_size").select("p_partkey", options.value_in_title(F.concat_ws("-", "p_name", "p_type"), F.col("values")).alias("value"))


@query("""select p_partkey, case when p_partkey % 3 < 2 then upper(substr(p_name, 1, 1)) || substr(p_name, 2) end as color, case when p_size % 4 = 3 then 'out_of_stock' when p_size % 4 = 1 then 'unknown' when p_size % 4 = 2 then 'low_stock' else 'in_stock' end as stock from part""")
def z09_title_colors_and_stock(spark, sf_dir):
    """Colours that titles begin with, and stock states."""
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99))
    title = _by(F.col("p_partkey") % 3, F.concat(name, F.lit(" T-Shirt from Next")), F.concat(F.lit("Next "), name, F.lit(" - Romper")), F.concat(F.lit("Baby "), name, F.lit(" Dress")))
    said = _by(F.col("p_size") % 4, F.lit("in_stock"), F.lit("odd"), F.lit("low_stock"), F.lit("in_stock"))
    return Tables(spark, sf_dir).part.select("p_partkey", options.title_color(title).alias("color"), options.stock_status(F.col("p_size") % 4 != 3, said).alias("stock"))


@query("""select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 1000 + p_size when 2 then 12 * p_size else p_size - 70 end::double as strict, case p_partkey % 4 when 0 then p_size when 1 then 1000 + p_size when 2 then 12 * p_size else p_size - 70 end::double as lenient,
    case p_partkey % 4 when 2 then 12 * p_size when 3 then p_size else 3000 end::double as sku from part""")
def o10_size_ranks(spark, sf_dir):
    """The three orders of sizes, of tokens made of the parts' sizes."""
    z, half, more = (c.cast("string") for c in (F.col("p_size"), F.floor(F.col("p_size") / 2), F.col("p_size") + 3))
    t = _by(F.col("p_partkey") % 4, F.concat(z, F.lit("-"), more, F.lit("M")), F.concat(F.lit("EU-"), z, F.lit("-UK-"), half), F.concat(z, F.lit("Y")), F.concat(F.lit("UP-TO-"), z, F.lit("M")))
    return Tables(spark, sf_dir).part.select("p_partkey", options.size_rank_strict(t).alias("strict"), options.size_rank_lenient(t).alias("lenient"), options.size_rank_sku(t).alias("sku"))


@query("""select event_id, case event_id % 4 when 3 then null else json_extract_string(props, '$.k') end as k, user_id || '|' || event_type as listed from events""")
def n01_tolerant_json(spark, sf_dir):
    """Broken JSON mended or null, and lists in two spellings, of the events' own properties."""
    broken = _by(F.col("event_id") % 4, F.regexp_replace("props", r"\}$", ",}"), F.concat(F.lit("<!-- "), "props", F.lit(" -->")), F.col("props"), F.regexp_replace("props", r"\}$", ""))
    who, what = F.col("user_id").cast("string"), F.col("event_type")
    lists = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(who, F.concat(F.lit(" "), what), F.lit("")))).otherwise(F.concat(who, F.lit(", "), what, F.lit("|")))
    k = F.try_variant_get(jsons.parsed(broken), "$.k", "string")
    return Tables(spark, sf_dir).events.select("event_id", k.alias("k"), F.array_join(jsons.as_list(lists), "|").alias("listed"))


@query("select p_partkey, upper(substr(sha1(p_name), 1, 8)) as short, sha256(p_name) as long from part")
def n07_hashes(spark, sf_dir):
    """Short and whole digests."""
    return Tables(spark, sf_dir).part.select("p_partkey", options.short_hash(F.col("p_name")).alias("short"), F.sha2("p_name", 256).alias("long"))


@query("""select p_partkey, p_name || ' & ' || p_brand || chr(189) as decoded, case p_partkey % 4 when 0 then 'https://h.com/x' || p_size || '?q=' || p_partkey when 1 then 'https://h.com/a/' || p_type || '.jpg' when 2 then null else 'https://c.com/z' || p_size end as absolute from part""")
def l04_arrow_functions(spark, sf_dir):
    """Character references and relative URLs, in Arrow batches."""
    z, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    source = F.concat("p_name", F.lit(" &amp; "), F.replace("p_brand", F.lit("#"), F.lit("&num;")), F.lit("&#189;"))
    link = _by(F.col("p_partkey") % 4, F.concat(F.lit("/x"), z, F.lit("?utm_source="), z, F.lit("&q="), k), F.concat("p_type", F.lit(".jpg#f"), z), F.concat(F.lit("data:image/png,"), k), F.concat(F.lit("//c.com/z"), z))
    return Tables(spark, sf_dir).part.select("p_partkey", extraction.html_unescape(source).alias("decoded"), extraction.url_join(link, F.lit("https://h.com/a/b")).alias("absolute"))


@query("""select p_partkey, 'https://x/' || lower(p_type) || p_partkey || '.jpg' || case when p_size % 2 = 0 then '?v=' || p_size else '' end as image, p_size as width, p_partkey % 3 > 0 as product from part""")
def l10_image_urls(spark, sf_dir):
    """Image URLs without sizes, the widths that they name, and which show products."""
    z, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    image = F.concat(F.lit("https://x/"), F.col("p_type"), k, F.lit(".JPG?w="), z, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("&v="), z)).otherwise(F.lit("")), F.lit("#t"))
    name = F.concat(F.lit("https://x/"), _by(F.col("p_partkey") % 3, F.lit("logo"), F.lit("p"), F.lit("q")), k, F.lit(".png"))
    return Tables(spark, sf_dir).part.select("p_partkey", urls.canonical_image(image).alias("image"), urls.image_width(image).alias("width"), urls.is_product_image(name).alias("product"))


_COLLECTIONS = list(text.COLLECTIONS.items())


@query(f"""select p_partkey, case when p_size % 3 = 1 then coalesce(nullif(trim(case when p_size % 2 = 0 then p_type else '' end), ''), case when p_size % 5 = 0 then 'Tops & T-shirts' else 'General' end)
    else case p_partkey % {len(_COLLECTIONS)} {" ".join(f"when {i} then '{v}'" for i, (_, v) in enumerate(_COLLECTIONS))} end end as collection, case when p_size % 2 = 0 then p_size end::int as row, substr(p_name, 1, 5) as head from part""")
def x11_collections_and_rows(spark, sf_dir):
    """Collections by all their other names, row numbers out of reasons, cut texts."""
    z = F.col("p_size")
    alias = F.concat(F.lit(" "), F.upper(_pick([k for k, _ in _COLLECTIONS])), F.lit(" "))
    name, path = F.when(z % 3 != 1, alias).when(z % 2 == 0, F.col("p_type")).otherwise(""), F.when(z % 5 == 0, F.concat(F.lit("/mens-shirts/"), F.col("p_name"))).otherwise(F.concat(F.lit("/x/"), F.col("p_name")))
    reason = F.when(z % 2 == 0, F.concat(F.lit("bad price in Row #"), z.cast("string"))).otherwise("none")
    return Tables(spark, sf_dir).part.select("p_partkey", text.collection(name, path).alias("collection"), text.row_number_in(reason).alias("row"), text.truncated(F.col("p_name"), 5).alias("head"))


@query("""select p_partkey, n || ' and ' || t || ' half set' as link, n || ' and ' || t || ' it s' as catalog, n || ' and ' || t as assisted, n as relation, n || ' and ' || t || ' half' as census from (select p_partkey, lower(p_name) as n, lower(p_type) as t from part)""")
def x05_five_titles(spark, sf_dir):
    """Each title normaliser on what sets it apart, over the parts' names and types."""
    made = lambda *parts: F.concat(F.col("p_name"), *[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(parts)])
    return Tables(spark, sf_dir).part.select(
        "p_partkey", text.title_link(made(" &amp; ", "p_type", " &#189; set")).alias("link"), text.title_catalog(made(" & ", "p_type", " It’s")).alias("catalog"), text.title_assisted(made("&amp;", "p_type")).alias("assisted"),
        text.title_relation(made(" (3-6 months) - Size XL")).alias("relation"), text.title_census(made(" &amp; ", "p_type", "&#xBD;")).alias("census"),
    )


@query("""select p_partkey, case when p_size % 5 = 0 then 0 when p_size % 5 = 1 then p_size + 1 else p_size end as quantity,
    case when p_size % 3 = 0 then p_type || chr(10) || p_brand when p_size % 3 = 1 then 'long ' || repeat('x', 200) when lower(p_name) = p_type then p_name || chr(10) || p_brand else p_name || chr(10) || p_type || chr(10) || p_brand end as description from part""")
def x12_nested_records(spark, sf_dir):
    """Stock deep inside a record, and descriptions filled up from it."""
    z = F.col("p_size")
    top = F.when(z % 5 == 0, F.concat(F.lit('"stock":-'), z.cast("string"), F.lit(","))).when(z % 5 == 1, F.concat(F.lit('"a":{"qty":0},"product":{"quantity":'), (z + 1).cast("string"), F.lit(".9},"))).otherwise("")
    raw = F.concat(F.lit("{"), top, F.lit('"id":"zz","details":["'), F.col("p_type"), F.lit(' ;; "],"care":{"description":"'), F.col("p_brand"), F.lit(' | ok"},"x":{"raw":{"qty":"'), z.cast("string"), F.lit('"}}}'))
    d = F.when(z % 3 == 1, F.concat(F.lit("long "), F.repeat(F.lit("x"), 200))).when(z % 3 == 2, F.col("p_name"))
    part = Tables(spark, sf_dir).part
    return nested.quantities(part, "p_partkey", raw).join(nested.enriched(part, "p_partkey", d, raw), "p_partkey")
