"""Variants: orders stand for products, their lines for variants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import money
from ..operators import matching, pricing, quality, variants
from .base import Tables, query


def _lines(spark, sf_dir):
    idx = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", idx.alias("idx"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")


LINES = "lines as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as idx, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag from lineitem)"


@query(f"""with {LINES}, f as (select l_orderkey, idx, 'sku:' || l_partkey as k1, 'combo:' || l_suppkey || '|' || l_returnflag as k2 from lines where idx % 2 = 1), s as (select l_orderkey, idx, 'sku:' || (l_partkey + l_partkey % 2) as k1, 'combo:' || l_suppkey || '|' || l_returnflag as k2 from lines),
    u as (select l_orderkey, k1 as key, idx, 0 as tier from f union all select l_orderkey, k2, idx, 1 from f union all select l_orderkey, k1, idx, null from s union all select l_orderkey, k2, idx, null from s),
    w as (select *, min(case when tier is null then idx end) over (partition by l_orderkey, key) as stored from u)
    select l_orderkey, idx, coalesce(arg_min(stored, tier) filter (where stored is not null), idx)::int as stored, (min(tier) filter (where stored is not null))::int as tier from w where tier is not null group by 1, 2""")  # fmt: skip
def j18_variant_cascade(spark, sf_dir):
    """Stored variants for fresh ones: by SKU, else by supplier and flag, else by position."""
    n = _lines(spark, sf_dir)
    combo = F.concat(F.lit("combo:"), F.col("l_suppkey").cast("string"), F.lit("|"), F.col("l_returnflag"))
    fresh = n.where("idx % 2 = 1").select("l_orderkey", "idx", F.array(F.concat(F.lit("sku:"), F.col("l_partkey").cast("string")), combo).alias("keys"))
    stored = n.select("l_orderkey", "idx", F.array(F.concat(F.lit("sku:"), (F.col("l_partkey") + F.col("l_partkey") % 2).cast("string")), combo).alias("keys"))
    return variants.matched(fresh, stored, "l_orderkey")


@query(f"""with {LINES}, a as (select l_orderkey, l_partkey, min(l_extendedprice) as p from lines where idx <> 2 group by 1, 2), b as (select l_orderkey, l_partkey, min(case when l_returnflag = 'R' then l_extendedprice + 1 else l_extendedprice + 0.001 end) as p from lines where idx <> 3 group by 1, 2)
    select l_orderkey, l_partkey, a.p as old_value, round(b.p, 3) as new_value, case when a.p is null then 'added' when b.p is null then 'removed' when abs(a.p - b.p) < 0.01 then 'same' else 'changed' end as change from a full join b using (l_orderkey, l_partkey)""")
def j19_keyed_diff(spark, sf_dir):
    """Two versions of the variants: added, removed, changed within a cent, same."""
    n = _lines(spark, sf_dir)
    old = n.where("idx <> 2").groupBy("l_orderkey", "l_partkey").agg(F.min("l_extendedprice").alias("p"))
    moved = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice") + 0.001)
    new = n.where("idx <> 3").groupBy("l_orderkey", "l_partkey").agg(F.min(moved).alias("p"))
    return matching.keyed_diff(old, new, ["l_orderkey", "l_partkey"], "p").withColumn("new_value", F.round("new_value", 3))


RULES = "rules as (select s_suppkey as rule_pos, case when s_suppkey % 3 = 0 then null else s_nationkey end as rule_supplier, case s_suppkey % 4 when 0 then null when 1 then 'AED' when 2 then ' usd ' else 'EUR' end as rule_currency, s_suppkey % 5 = 0 as is_default from supplier)"


@query(f"""with {RULES}, items as (select distinct c_nationkey as supplier_id, case c_custkey % 3 when 0 then 'AED' when 1 then 'USD' else '' end as currency from customer),
    s as (select *, (rule_supplier is null or rule_supplier = supplier_id) and (coalesce(upper(trim(rule_currency)), '') = '' or currency = '' or upper(trim(rule_currency)) = currency) as eligible,
    case when rule_supplier = supplier_id then 100 when rule_supplier is null then 10 else -100 end + case when currency <> '' and upper(trim(rule_currency)) = currency then 30 when coalesce(trim(rule_currency), '') = '' then 5 else -20 end + case when is_default then 15 else 0 end as score from items, rules)
    select supplier_id, currency, rule_pos, score::int as score from (select *, row_number() over (partition by supplier_id, currency order by eligible desc, score desc, rule_pos) as r from s) where r = 1""")
def j20_best_rule(spark, sf_dir):
    """The best pricing rule of every supplier and currency."""
    t = Tables(spark, sf_dir)
    k = F.col("s_suppkey") % 4
    rules = t.supplier.select(
        F.col("s_suppkey").alias("rule_pos"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("supplier_id"),
        F.when(k == 1, "AED").when(k == 2, " usd ").when(k == 3, "EUR").alias("currency"),
        (F.col("s_suppkey") % 5 == 0).alias("is_default"),
    )
    c = F.col("c_custkey") % 3
    items = t.customer.select(F.col("c_nationkey").alias("supplier_id"), F.when(c == 0, "AED").when(c == 1, "USD").otherwise("").alias("currency"))
    return pricing.best(items, rules).select("supplier_id", "currency", "rule_pos", F.col("score").cast("int").alias("score"))


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders) and (select count(distinct o_custkey) from orders) >= 50 and not ((select count(*) from customer) > 100 and (select count(*) from customer where c_custkey not in (select o_custkey from orders)) > 0.6 * (select count(*) from customer))""")
def j21_guarded_difference(spark, sf_dir):
    """Managed rows that the authority lacks, if it can be trusted."""
    t = Tables(spark, sf_dir)
    return matching.guarded_difference(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 0, least_urls=50, most_ratio=0.6)


@query("""select count(*) as n from customer where c_custkey not in (select o_custkey from orders) and false""")
def j21_guard_refuses(spark, sf_dir):
    """The same with a source that failed: nothing goes."""
    t = Tables(spark, sf_dir)
    out = matching.guarded_difference(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 1, least_urls=1)
    return out.agg(F.count("*").alias("n"))


@query(f"""with {LINES} select l_orderkey, count(*) > 0 and bool_and(l_returnflag = 'R') as all_sold_out, case when bool_or(l_quantity is null) then 'unknown' when bool_or(l_quantity > 40) then 'sellable' else 'not_sellable' end as sellability,
    case when max(l_extendedprice) / min(l_extendedprice) > 8 then 'price spread is implausible' when count(distinct l_partkey) < count(*) then 'duplicate SKUs' when count(*) > 6 then 'too many variants' end as gate from lines group by 1""")
def p09_strict_gate(spark, sf_dir):
    """First reason that keeps a product out, whether all is sold out, and whether any variant sells."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    gate = F.coalesce(
        F.when(F.max(price) / F.min(price) > 8, "price spread is implausible"),
        F.when(F.count_distinct("l_partkey") < F.count("*"), "duplicate SKUs"),
        F.when(F.count("*") > 6, "too many variants"),
    )
    sold_out, sell = quality.all_sold_out(F.col("l_returnflag") == "R"), quality.sellability(F.lit(True), qty, qty > 40)
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(sold_out.alias("all_sold_out"), sell.alias("sellability"), gate.alias("gate"))


@query(f"""with {LINES} select l_orderkey, string_agg(idx::varchar, ',' order by idx) as kept from (select l_orderkey, l_partkey % 5 as sig, min(idx) as idx from lines group by 1, 2) group by 1""")
def w02_dedupe_in_row(spark, sf_dir):
    """Variants without repeated signatures, folded in order."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "idx", (F.col("l_partkey") % 5).cast("string").alias("signature"))
    kept = variants.dedupe_rows(rows, "l_orderkey", "idx", ["signature"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("idx")).alias("kept"))
    return kept.select("l_orderkey", F.array_join(F.transform("kept", lambda i: i.cast("string")), ",").alias("kept"))


@query(f"""with recursive {LINES}, k as materialized (select *, ['a' || l_partkey % 5, 'b' || l_suppkey % 3] || case when l_partkey % 2 = 0 then ['c' || l_returnflag] else [] end as keys from lines),
    r as (select l_orderkey, 0 as idx, []::varchar[] as seen, false as kept from k group by 1 union all select k.l_orderkey, k.idx, case when list_has_any(seen, keys) then seen else list_concat(seen, keys) end, not list_has_any(seen, keys) from r join k on k.l_orderkey = r.l_orderkey and k.idx = r.idx + 1)
    select l_orderkey, idx, (l_partkey % 5)::varchar as signature, (l_suppkey % 3)::varchar as sku, case when l_partkey % 2 = 0 then l_returnflag else '' end as source_id from r join k using (l_orderkey, idx) where kept""")
def w02_dedupe_any_key(spark, sf_dir):
    """Variants that share signature, SKU or source id with no kept one; the SQL folds them in a recursion."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "idx", (F.col("l_partkey") % 5).cast("string").alias("signature"), (F.col("l_suppkey") % 3).cast("string").alias("sku"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("source_id"))
    return variants.dedupe_rows(rows, "l_orderkey", "idx", ["signature", "sku", "source_id"])


@query(f"""with {LINES} select l_orderkey, (count(distinct l_returnflag) * count(distinct l_suppkey % 3) * count(distinct l_partkey % 2))::int as sets, min(l_returnflag) || '/' || min(l_suppkey % 3) || '/' || min(l_partkey % 2) as first from lines group by 1""")
def j27_option_matrix(spark, sf_dir):
    """Cross product of the option values that an order's lines have."""
    own = lambda c: F.array_sort(F.collect_set(c.cast("string")))
    each = _lines(spark, sf_dir).groupBy("l_orderkey").agg(own(F.col("l_returnflag")).alias("a"), own(F.col("l_suppkey") % 3).alias("b"), own(F.col("l_partkey") % 2).alias("c"))
    p = each.select("l_orderkey", variants.product_sets({"Color": F.col("a"), "Size": F.col("b"), "Type": F.col("c")}).alias("s"))
    return p.select("l_orderkey", F.size("s").alias("sets"), F.concat_ws("/", F.col("s")[0]["Color"], F.col("s")[0]["Size"], F.col("s")[0]["Type"]).alias("first"))


@query(f"""with {LINES}, w as (select *, case l_orderkey % 4 when 0 then 'a' when 1 then 'r' when 2 then 'n' else '7' end as wanted from lines)
    select l_orderkey, 'u' || min(idx) filter (where lower(l_returnflag) = wanted and l_partkey % 2 = 0 or l_suppkey % 10 = 7 and wanted = '7') as url from w group by 1""")
def j23_image_by_color(spark, sf_dir):
    """An image for a colour among an order's lines: the first of that colour, or named as a word in its text."""
    image = F.struct("idx", F.concat(F.lit("u"), F.col("idx").cast("string")).alias("url"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.col("l_returnflag"), F.lit(" "))).alias("color"), F.concat(F.lit("No. "), (F.col("l_suppkey") % 10).cast("string"), F.lit(", 17")).alias("alt"))
    each = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(image)).alias("images"))
    wanted = F.array(*map(F.lit, ("a", "R", "n", "7")))[(F.col("l_orderkey") % 4).cast("int")]
    return each.select("l_orderkey", variants.image_for_color(F.col("images"), wanted).alias("url"))


@query(f"""with {LINES} select l_orderkey, idx, price, floor(price * 22 + 0.5) as shop_price, case when l_returnflag = 'R' then 0 else l_quantity::int end as quantity from (select *, min(l_extendedprice) over (partition by l_orderkey, l_partkey) as price, row_number() over (partition by l_orderkey, l_partkey order by idx) as n from lines) where n = 1""")
def e12_variant_payloads(spark, sf_dir):
    """What is written for each variant: price by rule, stock, once per key."""
    by = W.Window.partitionBy("l_orderkey", "l_partkey")
    each = _lines(spark, sf_dir).withColumn("price", F.min("l_extendedprice").over(by)).withColumn("n", F.row_number().over(by.orderBy("idx"))).where("n = 1")
    zero = F.lit(0.0)
    status = F.when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("in_stock")
    return each.select("l_orderkey", "idx", "price", money.price_by_rule(F.col("price"), F.lit(22.0), zero, zero, F.lit(".00"), zero, zero).alias("shop_price"), money.quantity(status, F.col("l_quantity")).alias("quantity"))


@query(f"""with {LINES}, a as (select l_orderkey, list(distinct l_partkey) as x from lines where idx <= 3 group by 1), b as (select l_orderkey, list(distinct l_partkey) as y from lines where idx >= 2 group by 1)
    select l_orderkey, array_to_string(list_sort(list_filter(coalesce(y, []), lambda p: not list_contains(coalesce(x, []), p))), ',') as added, array_to_string(list_sort(list_filter(coalesce(x, []), lambda p: not list_contains(coalesce(y, []), p))), ',') as removed from a full join b using (l_orderkey)""")
def j32_membership_diff(spark, sf_dir):
    """Ids that a set gained and lost."""
    n = _lines(spark, sf_dir)
    none = F.array().cast("array<bigint>")
    a = n.where("idx <= 3").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("x"))
    b = n.where("idx >= 2").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("y"))
    both = a.join(b, "l_orderkey", "full_outer").select("l_orderkey", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda p: p.cast("string")), ",")
    return both.select("l_orderkey", text(F.array_except("y", "x")).alias("added"), text(F.array_except("x", "y")).alias("removed"))
