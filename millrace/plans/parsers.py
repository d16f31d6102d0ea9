"""Site parsers' operators over records that are made of the orders: an order is a page, its line items are variants.

The records are JSON texts, pages or nested columns with whatever the tables hold; the SQL never sees those but computes
what must come out from the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import options
from ..operators import extraction, records, sites
from .base import Tables, query

#: Line items in order, numbered within their order.
LINES = """l as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, part, supp, qty, price, flag, st,
    row_number() over (partition by o_orderkey order by line, part, supp, qty, price, flag, st) as n from orders join (select l_orderkey, l_linenumber as line, l_partkey as part, l_suppkey as supp,
    l_quantity::int as qty, l_extendedprice as price, l_returnflag as flag, l_linestatus as st from lineitem) on l_orderkey = o_orderkey)"""
ORDER = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _orders(spark, sf_dir) -> DataFrame:
    """Orders with their line items as an array in order, without orders that have none."""
    t = Tables(spark, sf_dir)
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return t.orders.select(*ORDER).join(lines, "o_orderkey")


def _each(f) -> Column:
    return F.transform("lines", f)


def _some(condition, f) -> Column:
    """f of the line items for which the condition holds."""
    return F.transform(F.filter("lines", condition), f)


def _text(c: Column) -> Column:
    return c.cast("string")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


@query("""with l as (select p_partkey, p_name, p_size, l_extendedprice as price, l_returnflag as flag, l_linestatus as st from part left join lineitem on l_partkey = p_partkey),
g as (select p_partkey, any_value(p_name) as title, any_value(p_size) as size, max(price) filter (where flag = 'R' and price > 60000) as price, count(*) filter (where flag = 'R') as images, count(price) as variants,
    count(distinct flag) filter (where price is not null) as codes from l group by 1),
s as (select *, case when price is null and images > 0 then 'ask' when price is null then '' else 'x' end as raw, 20 + case when price is null then 0 else 20 end + case when images > 0 then 20 else 0 end + case when size > 25 then 10 else 0 end + case when variants > 0 then 10 else 0 end + case when codes > 0 then 5 else 0 end as confidence from g)
select p_partkey, confidence, array_to_string(list_filter([case when price is null then 'MISSING_PRICE' end, case when images = 0 then 'MISSING_IMAGES' end, case when variants = 0 then 'NO_VARIANTS' end, case when raw = 'ask' then 'PRICE_PARSE_FAILED' end,
    case when price is not null and images % 2 = 0 then 'CURRENCY_UNKNOWN' end, case when codes < variants then 'DUPLICATE_SKU' end, case when confidence < 70 then 'LOW_CONFIDENCE' end], lambda x: x is not null), ',') as warnings, price is not null as valid from s""")
def e08_scores_and_warnings(spark, sf_dir):
    """Confidence, warnings and validity of parts with what their line items give them."""
    t = Tables(spark, sf_dir)
    r = F.col("l_returnflag") == "R"
    g = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.when(r & (F.col("l_extendedprice") > 60000), F.col("l_extendedprice"))).alias("price"), F.count_if(r).alias("images"), F.count("*").alias("variants"), F.collect_list("l_returnflag").alias("codes"))
    p = t.part.join(g, "p_partkey", "left").withColumns({"images": F.coalesce("images", F.lit(0)), "variants": F.coalesce("variants", F.lit(0)), "codes": F.coalesce("codes", _none("string"))})
    raw = F.when(F.col("price").isNotNull(), _text(F.col("price"))).when(F.col("images") > 0, "ask").otherwise("")
    out = records.judged(F.col("p_name"), F.col("price"), raw, F.when(F.col("images") % 2 == 1, "AED"), F.when(F.col("p_size") > 25, F.col("p_type")), F.col("images"), F.col("variants"), F.col("codes"))
    return p.select("p_partkey", out.alias("o")).select("p_partkey", "o.confidence", F.array_join("o.warnings", ",").alias("warnings"), "o.valid")


@query(f"""with {LINES}, v as (select *, case when flag = 'N' then '' else flag end as c, case when st = 'F' then '' else qty::varchar end as s from l),
k as (select o_orderkey, count(distinct c) filter (where c <> '') as cs, max(c) as only_c, count(distinct s) filter (where s <> '') as ss, max(s) as only_s from v group by 1)
select o_orderkey, n, case when c = '' and cs = 1 then only_c else c end as color, case when s = '' and ss = 1 then only_s else s end as size from v join k using (o_orderkey)""")
def e09_normalised_options(spark, sf_dir):
    """Variants inherit an option's only value; default values choose nothing."""
    v = _each(lambda x: F.struct(F.when(x["flag"] == "N", "Default Title").otherwise(x["flag"]).alias("color"), F.when(x["st"] == "F", "Select a size").otherwise(_text(x["qty"])).alias("size")))
    each = _orders(spark, sf_dir).select("o_orderkey", F.posexplode(records.normalised(v)).alias("i", "v"))
    return each.select("o_orderkey", (F.col("i") + 1).cast("long").alias("n"), "v.color", "v.size")


@query("""select o_orderkey, count(l_orderkey) as variants, min(l_extendedprice) as price from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def e10_nested_products(spark, sf_dir):
    """Stored rows as nested products, read back."""
    p = records.nested(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    stored = p.select("l_orderkey", F.from_json(F.to_json("variants"), "array<struct<l_linenumber:int,l_partkey:bigint,l_extendedprice:double>>").alias("v"))
    orders = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return stored.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), F.size("v").cast("long").alias("variants"), F.array_min(F.transform("v", lambda x: x["l_extendedprice"])).alias("price"))


@query("""with u as (select p_partkey, case p_partkey % 5 when 0 then 'www.next.ae' when 1 then 'shop.zara.com' when 2 then 'www2.hm.com' when 3 then 'gap.' || p_type || '.ae' else replace(p_name, ' ', '-') || '.org' end as host, p_name from part)
select p_partkey, case when contains(lower(host), 'next.') then 'next.' when contains(lower(host), 'gap.') then 'gap.' when contains(host, 'zara') then 'zara' when contains(host, 'hm.com') then 'hm.com' else 'generic' end as parser from u""")
def e11_parser_choice(spark, sf_dir):
    """The first parser that a host fits, else the generic one."""
    k = F.col("p_partkey") % 5
    host = F.when(k == 0, "www.next.ae").when(k == 1, "shop.zara.com").when(k == 2, "www2.hm.com").when(k == 3, F.concat(F.lit("gap."), "p_type", F.lit(".ae"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".org")))
    return Tables(spark, sf_dir).part.select("p_partkey", records.parser_of(F.concat(F.lit("https://"), host, F.lit("/p/"), _text(F.col("p_size")))).alias("parser"))


@query(f"""with {LINES}, g as (select o_orderkey, any_value(o_orderstatus) as status, any_value(o_orderpriority) as priority, any_value(o_totalprice) as total, count(*) filter (where flag = 'R') as offers,
    arg_min(price, n) filter (where flag = 'R' and st = 'O') as own, count(distinct flag) as colors, count(distinct qty) filter (where st = 'F') as sizes from l group by 1)
select o_orderkey, case when status = 'O' then 'Order ' || o_orderkey when status = 'F' then priority else 'page' end as title, coalesce(own, case when status <> 'P' then total end) as price,
case when offers > 1 then offers when greatest(colors, 1) * greatest(sizes, 1) > 1 then greatest(colors, 1) * greatest(sizes, 1) else 1 end::int as variants from g""")
def e13_field_precedence(spark, sf_dir):
    """Fields and variants of pages from the first source that has them."""
    offers = _some(lambda x: x["flag"] == "R", lambda x: F.struct(F.when(x["st"] == "O", F.concat(F.lit("AED "), _text(x["price"]))).otherwise("ask").alias("price"), _text(x["part"]).alias("sku")))
    ld = F.struct(F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Order  "), _text(F.col("o_orderkey")))).alias("name"), offers.alias("offers"))
    page = F.struct(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), "o_orderpriority")).alias("og_title"), F.lit("page").alias("dom_title"), F.when(F.col("o_orderstatus") != "P", _text(F.col("o_totalprice"))).alias("price"), _each(lambda x: x["flag"]).alias("colors"), _some(lambda x: x["st"] == "F", lambda x: _text(x["qty"])).alias("sizes"))
    raw = F.from_json(F.to_json(ld), "name string, offers array<struct<price:string,sku:string>>")
    return _orders(spark, sf_dir).select("o_orderkey", records.generic_product(raw, page).alias("o")).select("o_orderkey", "o.*")


@query(f"""with {LINES} select o_orderkey, count(distinct part) filter (where supp % 3 > 0 and part::varchar like '1%') as variants, coalesce(min(n) filter (where supp % 3 > 0 and part::varchar like '1%'), 0) as first from l group by 1""")
def e15_sibling_products(spark, sf_dir):
    """Sibling records of one page and code prefix as variants, each SKU once."""
    k = lambda x: x["supp"] % 3
    made = F.transform("lines", lambda x, i: F.struct(F.concat(F.lit("https://x/p"), F.when(k(x) == 0, "/other").when(k(x) == 1, "?c=7").otherwise("#top")).alias("url"), F.concat(F.lit("W"), _text(x["part"])).alias("sku"), (i + 1).cast("long").alias("n")))
    v = records.sibling_variants(made, F.lit("https://x/p"), F.lit("W1"))
    return _orders(spark, sf_dir).select("o_orderkey", v.alias("v")).select("o_orderkey", F.size("v").cast("long").alias("variants"), F.coalesce(F.get("v", F.lit(0))["n"], F.lit(0)).alias("first"))


@query(f"""with {LINES} select o_orderkey, case when any_value(o_orderstatus) = 'F' then count(*) filter (where qty > 10) else count(*) end as rows,
count(*) filter (where (any_value_status <> 'F' or deep = 0 or qty > 10) and case flag when 'R' then false when 'A' then st = 'O' else true end) as orderable
from (select *, o_orderstatus as any_value_status, count(*) filter (where qty > 10) over (partition by o_orderkey) as deep from l) group by 1 having any_value(any_value_status) <> 'F' or any_value(deep) > 0
union all select o_orderkey, count(*), count(*) filter (where case flag when 'R' then false when 'A' then st = 'O' else true end) from (select *, count(*) filter (where qty > 10) over (partition by o_orderkey) as deep from l) where o_orderstatus = 'F' and deep = 0 group by 1""")
def e17_two_level_variants(spark, sf_dir):
    """Rows from two levels, or the flat list where there are none; what may be ordered by the first flag that is there."""
    row = lambda x: F.struct(_text(x["part"]).alias("id"), F.when(x["flag"] == "R", F.lit(False)).alias("orderable"), F.when(x["flag"] == "A", x["st"] == "O").alias("available"))
    deep = F.array(F.struct(_some(lambda x: (x["qty"] > 10) & (x["qty"] <= 30), row).alias("skus")), F.struct(_some(lambda x: x["qty"] > 30, row).alias("skus")))
    kind = "array<struct<skus:array<struct<id:string,orderable:boolean,available:boolean>>>>"
    groups = F.when(F.col("o_orderstatus") == "F", F.from_json(F.to_json(deep), kind)).otherwise(F.array().cast(kind))
    rows = records.two_level_rows(groups, _each(row))
    return _orders(spark, sf_dir).select("o_orderkey", rows.alias("r")).select("o_orderkey", F.size("r").cast("long").alias("rows"), F.size(F.filter("r", lambda x: x["can_order"])).cast("long").alias("orderable"))


@query(f"""with {LINES}, s(low, high, name) as (values {", ".join(map(str, options.LADDER))}), g as (select o_orderkey, any_value(o_custkey) % 3 + 1 as years, any_value(o_orderstatus) as status, string_agg(qty::varchar, ',' order by n) filter (where flag = 'R') as said from l group by 1)
select o_orderkey, coalesce(said, case status when 'O' then (select string_agg(name, ',' order by low, high) from s where low >= 3 and high <= 12 * years) when 'F' then 'S,M,L' else '' end) as sizes from g""")
def e20_sizes_by_fallback(spark, sf_dir):
    """Sizes that are spelled out, else a ladder from the title's ages, else S, M, L for slippers with a picker."""
    title = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Suit (3mths - "), _text(F.col("o_custkey") % 3 + 1), F.lit("yrs)"))).otherwise("Slippers")
    sizes = records.sizes_of(_some(lambda x: x["flag"] == "R", lambda x: _text(x["qty"])), title, F.col("o_orderstatus") == "F")
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(sizes, ",").alias("sizes"))


@query(f"""with {LINES} select a.o_orderkey, a.n, (select 'S' || b.supp from l b where b.o_orderkey = a.o_orderkey and b.st = 'O' and b.supp = a.supp limit 1) as size, case when a.st = 'O' then a.qty > 25 else a.flag <> 'R' end as available from l a""")
def e21_attribute_labels(spark, sf_dir):
    """Codes as labels by attribute and value; stock by count where it is managed, else by behaviour."""
    values = _some(lambda x: x["st"] == "O", lambda x: F.struct(_text(x["supp"]).alias("code"), F.concat(F.lit("S"), _text(x["supp"])).alias("label")))
    o = _orders(spark, sf_dir).withColumn("labels", records.option_labels(F.to_json(F.array(F.struct(F.lit("color").alias("attribute"), values.alias("values")), F.struct(F.lit("size").alias("attribute"), values.alias("values"))))))
    each = o.select("o_orderkey", "labels", F.posexplode("lines").alias("i", "x"))
    available = records.in_stock(F.col("x.st") == "O", F.greatest(F.lit(0), F.col("x.qty") - 25), F.when(F.col("x.flag") == "R", "HideProduct").otherwise("Allow"))
    return each.select("o_orderkey", (F.col("i") + 1).cast("long").alias("n"), F.try_element_at("labels", F.concat(F.lit("size/"), _text(F.col("x.supp")))).alias("size"), available.alias("available"))


@query(f"""with {LINES}, g as (select o_orderkey, any_value(o_custkey) as cust, any_value(o_orderstatus) as status, any_value(o_totalprice) as total, count(*) filter (where flag = 'R') as images, count(*) filter (where st = 'O') as skus, arg_min(part, n) as part from l group by 1)
select o_orderkey, case when cust % 5 = 0 then 'snapshot is of another product' when status = 'P' and total > 250000 then 'no AED price' when images = 0 then 'no image' when skus = 0 then 'no size with a SKU' end as rejected, 'en ' || part as name from g""")
def e22_snapshot_gates(spark, sf_dir):
    """The first gate that a pasted snapshot fails; the English attribute."""
    c = F.col("o_custkey")
    price = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000), F.concat(F.lit("USD "), _text(F.col("o_totalprice")))).otherwise(F.concat(F.lit("AED "), _text(F.col("o_totalprice"))))
    images = _some(lambda x: x["flag"] == "R", lambda x: F.concat(F.lit("https://x/"), _text(x["part"]), F.lit(".jpg")))
    gate = records.snapshot_gate(F.concat(F.lit("https://x/a-p-"), _text(c), F.lit(".html")), _text(F.when(c % 5 == 0, c + 1).otherwise(c)), price, F.col("o_orderpriority"), images, _each(lambda x: F.when(x["st"] == "O", _text(x["part"])).otherwise("")))
    first = _text(F.get("lines", F.lit(0))["part"])
    name = records.in_english(F.array(*[F.struct(F.lit(k).alias("lang"), F.concat(F.lit(f"{k} "), first).alias("value")) for k in ("ar", "en")]))
    return _orders(spark, sf_dir).select("o_orderkey", gate.alias("rejected"), name.alias("name"))


@query(f"""with {LINES} select o_orderkey, arg_min(case flag when 'R' then 'Green' else supp::varchar end, n) filter (where flag <> 'N') as color, string_agg('https://x/a' || qty || '.jpg', ',' order by qty) as images, bool_or(qty = 50) as sold_out from l group by 1""")
def e23_first_color_and_images(spark, sf_dir):
    """The first candidate that is a colour; images by the number in their name; one sold-out variant marks all."""
    colors = _each(lambda x: F.when(x["flag"] == "N", F.when(x["st"] == "O", "Default").otherwise("https://x/y.png")).when(x["flag"] == "R", "Colour: Green").otherwise(_text(x["supp"])))
    images = records.by_number(_each(lambda x: F.concat(F.lit("https://x/a"), _text(x["qty"]), F.lit(".jpg"))))
    return _orders(spark, sf_dir).select("o_orderkey", records.first_color(colors).alias("color"), F.array_join(images, ",").alias("images"), F.exists("lines", lambda x: x["qty"] == 50).alias("sold_out"))


@query(f"""with {LINES} select a.o_orderkey, a.n, (select 'Size ' || b.supp from l b where b.o_orderkey = a.o_orderkey and b.flag = 'A' and b.supp = a.supp limit 1) as size,
case when o_orderstatus = 'O' then o_totalprice else min(price) over (partition by o_orderkey) end as price from l a""")
def e24_selections(spark, sf_dir):
    """Selection ids as option values, an attribute by name, a simple price or else the range's least."""
    lookup = records.option_labels(F.to_json(F.array(F.struct(F.lit("size").alias("attribute"), _some(lambda x: x["flag"] == "A", lambda x: F.struct(_text(x["supp"]).alias("code"), F.concat(F.lit("Size "), _text(x["supp"])).alias("label"))).alias("values")))))
    attributes = F.array(F.struct(F.lit("brand").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("Final_Price").alias("name"), F.when(F.col("o_orderstatus") == "O", _text(F.col("o_totalprice"))).otherwise("").alias("value")))
    spread = F.concat_ws(" - ", _each(lambda x: F.concat(F.lit("AED "), _text(x["price"]))))
    price = records.price_or_range(records.attribute(attributes, "price", "final_price"), spread)
    each = _orders(spark, sf_dir).withColumns({"labels": lookup, "price": price}).select("o_orderkey", "labels", "price", F.posexplode("lines").alias("i", "x"))
    return each.select("o_orderkey", (F.col("i") + 1).cast("long").alias("n"), F.try_element_at("labels", F.concat(F.lit("size/"), _text(F.col("x.supp")))).alias("size"), "price")


@query(f"""with {LINES} select o_orderkey, case when any_value(o_orderstatus) = 'P' then any_value(o_orderpriority) else 'api' end as title, coalesce(string_agg(part::varchar, ',' order by n) filter (where qty > 25), '') as sizes,
min(price - 50000) filter (where price > 50000 and flag <> 'N') as least, max(price - 50000) filter (where price > 50000 and flag <> 'N') as most from l group by 1 having count(*) filter (where flag <> 'N') > 0
union all select o_orderkey, case when any_value(o_orderstatus) = 'P' then any_value(o_orderpriority) else 'api' end, coalesce(string_agg(part::varchar, ',' order by n) filter (where qty > 25), ''), any_value(o_totalprice), any_value(o_totalprice) from l group by 1 having count(*) filter (where flag <> 'N') = 0""")
def e25_overlay(spark, sf_dir):
    """An API record over a fallback, field by field; sold-out sizes go; bounds of the positive prices."""
    size = lambda x: F.struct(_text(x["part"]).alias("size"), (x["qty"] - 25).alias("stock"))
    api = F.struct(F.when(F.col("o_orderstatus") == "P", " ").otherwise("api").alias("title"), _some(lambda x: x["flag"] != "N", lambda x: x["price"] - 50000).alias("prices"), _some(lambda x: x["flag"] == "none", size).alias("sizes"))
    own = F.struct(F.col("o_orderpriority").alias("title"), F.array("o_totalprice").alias("prices"), _each(size).alias("sizes"))
    return _orders(spark, sf_dir).select("o_orderkey", records.overlaid(api, own).alias("r")).select("o_orderkey", "r.title", F.array_join("r.sizes", ",").alias("sizes"), "r.least", "r.most")


@query(f"""with {LINES} select o_orderkey, string_agg(qty::varchar, ',' order by n) as sizes, any_value(o_orderstatus) = 'O' or bool_or(flag = 'R' and st = 'O') as available from l group by 1""")
def e26_size_attribute(spark, sf_dir):
    """Values of a size attribute as variants; available by flag, or if any can be selected."""
    raw = F.to_json(_each(lambda x: F.struct(_text(x["qty"]).alias("value"), F.when(x["flag"] == "R", x["st"] == "O").alias("selectable"))))
    out = records.size_attribute(F.from_json(raw, "array<struct<value:string,selectable:boolean>>"), F.when(F.col("o_orderstatus") == "O", F.lit(True)))
    return _orders(spark, sf_dir).select("o_orderkey", out.alias("r")).select("o_orderkey", F.array_join("r.sizes", ",").alias("sizes"), "r.available")


@query(f"""with {LINES}, c as (select o_orderkey, part, case when st = 'O' then price else o_totalprice end as price, row_number() over (partition by o_orderkey, part order by n) as r from l where flag <> 'N')
select o_orderkey, 'c' || part as id, price, size from c, (select unnest(['S', 'M']) as size) where r = 1""")
def e28_colorways(spark, sf_dir):
    """Cards of one style in a markdown page, each id once, with its own price or the page's, times the sizes."""
    style = F.concat(F.lit("st"), _text(F.col("o_custkey")))
    card = lambda x: F.concat(F.lit("[Color "), _text(x["supp"]), F.lit("](/style/"), F.when(x["flag"] == "N", F.concat(style, F.lit("9"))).otherwise(style), F.lit("/c"), _text(x["part"]), F.lit(")"), F.when(x["st"] == "O", F.concat(F.lit(" AED "), _text(x["price"]))).otherwise(" sold out"))
    page = F.array_join(F.concat(F.array(F.concat(F.lit("# Order "), _text(F.col("o_orderkey")))), _each(card)), "\n")
    found = records.colorways(page, style, F.lit("none"), F.col("o_totalprice"))
    each = _orders(spark, sf_dir).select("o_orderkey", F.explode(found).alias("c"))
    return each.select("o_orderkey", "c.id", "c.price", F.explode(F.array(F.lit("S"), F.lit("M"))).alias("size"))


@query(f"""with {LINES} select o_orderkey, string_agg('L' || part || case when flag = 'A' and st = 'F' then '-' else '' end, ':' order by case when flag = 'N' then 0 else supp end, n) as sizes,
string_agg(case when flag = 'R' then 'c' || supp else o_orderpriority end, ':' order by case when flag = 'N' then 0 else supp end, n) as colors from l group by 1""")
def e30_state_variants(spark, sf_dir):
    """Variants of a state object: labels by id, the default colour inherited, sizes by their display order."""
    state = F.struct(_each(lambda x: F.struct(_text(x["part"]).alias("option"), F.when(x["flag"] == "R", F.concat(F.lit("c"), _text(x["supp"]))).alias("color"), F.when(x["flag"] != "N", x["supp"]).alias("order"), F.when(x["flag"] == "A", x["st"] == "O").alias("in_stock"))).alias("variants"))
    raw = F.from_json(F.to_json(state), "variants array<struct<option:string,color:string,order:bigint,available:boolean,in_stock:boolean>>")
    labels = F.map_from_entries(F.array_distinct(_each(lambda x: F.struct(_text(x["part"]).alias("k"), F.concat(F.lit("L"), _text(x["part"])).alias("v")))))
    v = _orders(spark, sf_dir).select("o_orderkey", records.state_variants(raw["variants"], labels, F.col("o_orderpriority")).alias("v"))
    return v.select("o_orderkey", F.array_join(F.transform("v", lambda r: F.concat(r["size"], F.when(r["can_order"], "").otherwise("-"))), ":").alias("sizes"), F.array_join(F.transform("v", lambda r: r["color"]), ":").alias("colors"))


@query("""select o_orderkey, o_orderpriority as title, o_custkey % 3 = 0 or o_orderstatus = 'F' as sold_out from orders""")
def e31_script_json(spark, sf_dir):
    """JSON that a script assigns, by the first path that is there; sold out if stock, status or the on-sale flag is 0."""
    o = Tables(spark, sf_dir).orders
    body = F.concat(F.lit('{"goods": {"name": "'), "o_orderpriority", F.lit('", "stock": '), _text(F.col("o_custkey") % 3), F.lit(', "text": "a } in \\" quotes", "on_sale": '), F.when(F.col("o_orderstatus") == "F", "0").otherwise("1"), F.lit(",},}"))
    name = F.when(F.col("o_orderstatus") == "P", "gbRawData").otherwise("goodsDetail")
    script = F.concat(F.lit("var a = {}; window."), name, F.lit(" = "), body, F.lit("; window.other = {};"))
    found = records.assigned(script, F.lit("gbRawData|goodsDetail"))
    return o.select("o_orderkey", found.alias("raw")).select("o_orderkey", records.goods(F.col("raw")).alias("r")).select("o_orderkey", "r.title", "r.sold_out")


@query(f"""with {LINES} select o_orderkey, case when any_value(o_orderstatus) = 'F' then 'Order ' || o_orderkey else any_value(o_orderpriority) end as title, arg_max(price, n) as price, count(*) filter (where flag <> 'N') as sizes, count(*) filter (where st = 'O') as images from l group by 1""")
def e32_markdown_pages(spark, sf_dir):
    """Markdown pages: heading first, the price last before the VAT line, a bounded size section, image links."""
    line = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    heading = F.when(F.col("o_orderstatus") == "F", line("# Order  ", _text(F.col("o_orderkey")))).otherwise(_none("string"))
    prices = _each(lambda x: F.concat(F.lit("now AED "), _text(x["price"])))
    sizes = _some(lambda x: x["flag"] != "N", lambda x: F.concat(F.lit(" "), _text(x["qty"])))
    images = _each(lambda x: F.concat(F.lit("![x](https://x/"), F.when(x["st"] == "O", "a").otherwise("logo"), _text(x["part"]), F.lit(".jpg)")))
    page = F.array_join(F.concat(line("Title: ", F.col("o_orderpriority")), heading, prices, line("Inclusive of VAT"), line("AED 1 delivery"), line("Size"), sizes, line("Overview of ", _text(F.col("o_custkey"))), images), "\n")
    out = _orders(spark, sf_dir).select("o_orderkey", page.alias("page")).select("o_orderkey", records.markdown_product(F.col("page")).alias("r"))
    return out.select("o_orderkey", "r.title", "r.price", F.size("r.sizes").cast("long").alias("sizes"), F.size("r.images").cast("long").alias("images"))


@query("""select s_suppkey, s_name || ' (' || (s_suppkey % 7) || ')' as title, round(abs(s_acctbal), 2) as price, 2 as nodes from supplier""")
def n04_json_ld_nodes(spark, sf_dir):
    """Products of JSON-LD texts, through arrays and graphs."""
    s = Tables(spark, sf_dir).supplier
    graph = F.concat(F.lit('<script type="application/ld+json">[{"@graph":[{"@type":["Product"],"name":"'), "s_name", F.lit(" ("), _text(F.col("s_suppkey") % 7), F.lit(')","offers":[{"price":"'), _text(F.round(F.abs("s_acctbal"), 2)), F.lit('"}]}]},{"@type":"ProductGroup","name":"group"},{"@type":"Thing","name":"none"}]</script>'))
    found = extraction.candidates(s.select(F.col("s_suppkey").alias("page_id"), F.lit("https://x/").alias("url"), graph.alias("html"))).where("source = 'json_ld'")
    first = F.min_by(F.struct("title", F.col("raw_price").try_cast("double").alias("price")), "pos").alias("r")
    return found.groupBy(F.col("page_id").alias("s_suppkey")).agg(first, F.count("*").cast("int").alias("nodes")).select("s_suppkey", "r.title", "r.price", "nodes")


@query("""select p_brand, count(*) as products, count(*) filter (where r = 1) as firsts from (select p_brand, row_number() over (partition by p_brand, p_type order by p_partkey) as r from part) group by 1""")
def e09_option_groups(spark, sf_dir):
    """Options merged by name: how many values, each once."""
    r = F.row_number().over(W.Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    each = Tables(spark, sf_dir).part.select("p_brand", r.alias("r"))
    return each.groupBy("p_brand").agg(F.count("*").alias("products"), F.count_if(F.col("r") == 1).alias("firsts"))


@query(f"""with {LINES}, g as (select o_orderkey, any_value(o_orderstatus) as status, any_value(o_orderpriority) as priority, any_value(o_totalprice) as total, coalesce(string_agg(qty::varchar, ',' order by n) filter (where flag = 'R'), '') as sizes from l group by 1)
select o_orderkey, case when status <> 'P' then priority end as title, case when status <> 'P' then total end as price, sizes, case when status = 'P' then 'no price' when sizes = '' then 'a size picker without sizes' end as rejected from g""")
def e27_line_windows(spark, sf_dir):
    """Line-oriented pages: a title before the price line, sizes between a marker and a stop, and what is rejected."""
    price = F.when(F.col("o_orderstatus") == "P", "ask").otherwise(F.concat(F.lit("AED "), _text(F.col("o_totalprice"))))
    head = F.array(F.lit("Shop"), F.lit("  "), F.concat(F.col("o_orderpriority"), F.lit(" ")), price, F.lit("Choose a size"))
    page = F.array_join(F.concat(head, _some(lambda x: x["flag"] == "R", lambda x: F.concat(F.lit(" "), _text(x["qty"]))), F.array(F.lit("Details")), _each(lambda x: _text(x["part"]))), "\n")
    out = _orders(spark, sf_dir).withColumn("page", page).select("o_orderkey", records.snapshot(records.lines_of(F.col("page"))).alias("r"))
    return out.select("o_orderkey", "r.title", "r.price", F.array_join("r.sizes", ",").alias("sizes"), "r.rejected")


@query(f"""with {LINES}, d as (select o_orderkey, st, qty, min(struct_pack(a := case when flag = 'N' then 0 else supp end, b := n)) as k, min(n) as n from l group by 1, 2, 3),
v as (select o_orderkey, st, string_agg(qty::varchar, ',' order by k) as labels, min(n) as n from d group by 1, 2) select o_orderkey, string_agg(st || '=' || labels, ';' order by n) as options from v group by 1""")
def e18_option_labels(spark, sf_dir):
    """Options of a record merged by name, their labels by display order."""
    rows = F.to_json(_each(lambda x: F.struct(_text(x["part"]).alias("id"), x["st"].alias("name"), _text(x["qty"]).alias("label"), F.when(x["flag"] != "N", x["supp"]).alias("order"))))
    made = records.merged_options(F.from_json(rows, "array<struct<id:string,name:string,label:string,order:bigint>>"))
    out = _orders(spark, sf_dir).select("o_orderkey", made.alias("o"))
    return out.select("o_orderkey", F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["name"], F.array_join(x["values"], ","))), ";").alias("options"))


@query("""with p as (select o_orderkey, any_value(said) as colour, min(l_extendedprice) as price, max(l_extendedprice) as most, bool_or(l_linenumber = 3) as stocked, count(distinct l_quantity::int) filter (where l_returnflag <> 'R') as sizes, min(l_quantity::int) filter (where l_returnflag <> 'R') as least, count(distinct l_suppkey) + 1 as images
        from (select o.o_orderkey, case when o.o_orderkey % 3 > 0 then 'Red' end as said, l.* from orders as o join lineitem as l on l.l_orderkey = o.o_orderkey) group by 1)
    select o_orderkey, 'H' || o_orderkey as id, 'Order ' || o_orderkey as title, colour as color, price, most, 'AED' as currency, images::int as images, sizes::int as variants, case when sizes > 0 then 'H' || o_orderkey || '-EU-' || least end as first_sku, stocked as in_stock from p""")
def e11_storefront_records(spark, sf_dir):
    """Whole products from a storefront's records, made of the orders and their lines: a line is a size, its supplier an image."""
    t = Tables(spark, sf_dir)
    line = F.struct("l_quantity", "l_returnflag", "l_extendedprice", "l_suppkey", "l_linenumber")
    each = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    k = F.col("o_orderkey").cast("string")
    sizes = F.transform("l", lambda x: F.struct(F.concat(F.lit(" EU "), x["l_quantity"].cast("int").cast("string")).alias("title"), (x["l_returnflag"] != "R").alias("inStock")))
    assets = F.to_json(F.transform("l", lambda x: F.struct(F.lit("no url").alias("url"), F.struct(F.concat(F.lit("https://h.com/"), x["l_suppkey"].cast("string"), F.lit(".jpg")).alias("product_zoom_large_800x800")).alias("styles"))))
    amount = lambda c: F.struct(F.struct(F.struct(c.alias("value"), F.lit("AED").alias("currency")).alias("amount")).alias("final"))
    prices = F.transform("l", lambda x: x["l_extendedprice"])
    attributes = F.array(F.struct(F.lit("assets_pdp").alias("name"), F.lit(None).cast("string").alias("label"), assets.alias("value")), F.struct(F.lit("x").alias("name"), F.lit("Colour").alias("label"), F.when(F.col("o_orderkey") % 3 > 0, "Red").alias("value")))
    record = F.to_json(F.struct(
        F.concat(F.lit("H"), k).alias("sku"), F.concat(F.lit(" Order  "), k).alias("name"), F.exists("l", lambda x: x["l_linenumber"] == 3).alias("inStock"), F.array(F.struct(F.lit("https://h.com/main.jpg").alias("url"))).alias("images"), attributes.alias("attributes"),
        F.array(F.struct(F.lit("Size").alias("id"), sizes.alias("values"))).alias("options"),
        F.struct(amount(F.array_min(prices)).alias("minimum"), amount(F.array_max(prices)).alias("maximum")).alias("priceRange"),
    ))
    p = each.select("o_orderkey", sites.storefront(record, F.lit("https://www2.hm.com/en/productpage.1.html")).alias("p"), F.array_min(F.transform(F.filter("l", lambda x: x["l_returnflag"] != "R"), lambda x: x["l_quantity"].cast("int"))).alias("least"))
    first = F.get(F.filter(F.transform("p.variants", lambda v: v["sku"]), lambda s: s.endswith(F.concat(F.lit("-EU-"), F.col("least").cast("string")))), F.lit(0))
    return p.select("o_orderkey", "p.id", "p.title", "p.color", "p.price", "p.most", "p.currency", F.size("p.images").alias("images"), F.size("p.variants").alias("variants"), first.alias("first_sku"), "p.in_stock")
