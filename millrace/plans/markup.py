"""Pieces of the extraction pipeline on pages made of part."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import money, options
from ..operators import extraction
from .base import Tables, query


def _found(spark, sf_dir, html, source: str):
    n = F.col("p_partkey").cast("string")
    pages = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.ae/p/"), n).alias("url"), html.alias("html"))
    return extraction.candidates(pages).where(F.col("source") == source)


@query("""select p_partkey as page_id, p_name as title, 'Q' || p_partkey as sku, 'AED' as currency from part""")
def e02_embedded_state(spark, sf_dir):
    """Products out of state that scripts carry, braces in strings and all."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    node = F.concat(F.lit('{"a":{"x":[{"name":"'), F.col("p_name"), F.lit('","price":"AED 5","sku":"Q'), n, F.lit('"}],"note":"}"}}'))
    html = F.when(k == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="x">'), node, F.lit("</script>"))).when(k == 1, F.concat(F.lit("<script type='application/json'>"), node, F.lit("</script>"))).otherwise(F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), node, F.lit("; var y={};</script>")))
    out = extraction.merged(_found(spark, sf_dir, html, "embedded"))
    return out.select("page_id", "title", "sku", "currency")


@query("""select p_partkey as page_id, 'OG ' || p_name as title, p_size || '.00' as raw_price, '/c/' || p_partkey as canonical from part""")
def e03_open_graph(spark, sf_dir):
    """OpenGraph fields and the canonical link."""
    n = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<meta name="og:title" content="wrong"><meta property="og:title" content=" OG '), F.col("p_name"), F.lit('"><meta property="product:price:amount" content="'), F.col("p_size").cast("string"), F.lit('.00"><link rel="canonical" href="/c/'), n, F.lit('">'))
    return _found(spark, sf_dir, html, "open_graph").select("page_id", "title", "raw_price", "canonical")


@query("""select p_partkey as page_id, 'https://shop.ae/o.jpg,https://shop.ae/p/b.jpg,https://shop.ae/s.jpg?v=' || p_size as images from part""")
def e05_images(spark, sf_dir):
    """Images of a page: OpenGraph first, best of each set, no junk, each once."""
    html = F.concat(F.lit('<meta property="og:image" content="/o.jpg"><img src="/logo.svg"><img srcset="a.jpg 1x, b.jpg 2x"><img src="/o.jpg#t"><picture><source srcset="/s.jpg?utm_x=1&amp;v='), F.col("p_size").cast("string"), F.lit(' 3w"></picture>'))
    return _found(spark, sf_dir, html, "dom").select("page_id", F.array_join("images", ",").alias("images"))


@query("""select p_partkey as page_id, 'Size:42|43;Color:Red' as options, 3 as variants from part""")
def e06_options(spark, sf_dir):
    """Options and variants out of controls."""
    html = F.concat(F.lit('<label for="z">Shoe size</label><select id="z"><option>Select a size<option value="1">42<option>43</select><button data-sku="B'), F.col("p_partkey").cast("string"), F.lit('">Red</button>'))
    each = F.transform(F.arrays_zip("option_names", "option_values"), lambda x: F.concat(x["option_names"], F.lit(":"), F.array_join(x["option_values"], "|")))
    return _found(spark, sf_dir, html, "dom").select("page_id", F.array_join(each, ";").alias("options"), F.size("variants").alias("variants"))


@query("""with v as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as idx, 'c' || l_partkey % 3 as color, l_partkey % 4 as size, l_returnflag <> 'R' as available, l_extendedprice as price from lineitem),
    k as (select *, row_number() over (partition by l_orderkey, color, size order by available desc, idx) as n from v where not (size = 3 and exists (select 1 from v w where w.l_orderkey = v.l_orderkey and w.size <> 3)))
    select l_orderkey, count(*) as variants, count(*) filter (where available) as available from k where n = 1 group by 1""")
def e16_color_size_variants(spark, sf_dir):
    """A variant for each colour and size, an available one if there is one; a placeholder size only where it is all there is."""
    idx = F.row_number().over(W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    v = Tables(spark, sf_dir).lineitem.select("l_orderkey", idx.alias("idx"), (F.col("l_partkey") % 3).alias("color"), (F.col("l_partkey") % 4).alias("size"), (F.col("l_returnflag") != "R").alias("available"))
    real = F.max(F.col("size") != 3).over(W.Window.partitionBy("l_orderkey"))
    fine = v.withColumn("real", real).where((F.col("size") != 3) | ~F.col("real"))
    n = F.row_number().over(W.Window.partitionBy("l_orderkey", "color", "size").orderBy(F.desc("available"), "idx"))
    return fine.withColumn("n", n).where("n = 1").groupBy("l_orderkey").agg(F.count("*").alias("variants"), F.count_if("available").alias("available"))


@query("""with o as (select p_partkey, unnest([1, 2, 3]) as number from part), p as (select p_partkey, unnest([1, 2]) as number, unnest([p_size + 0.5, case when p_size % 2 = 0 then 0 else p_size + 1.5 end]) as price from part) select p_partkey, number, price::double as price, number <> 1 as available from o join p using (p_partkey, number) where price > 0""")
def e14_options_with_prices(spark, sf_dir):
    """Options joined to a price table by option number; without size or price they go; stock by text."""
    part, z = Tables(spark, sf_dir).part, F.col("p_size")
    o = part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(s).alias("stock")) for i, s in ((1, "Sold Out"), (2, "In Stock"), (3, ""))])).alias("o")).select("p_partkey", "o.*")
    p = part.select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("number"), (z + 0.5).cast("double").alias("price")), F.struct(F.lit(2).alias("number"), F.when(z % 2 == 0, 0.0).otherwise(z + 1.5).cast("double").alias("price")))).alias("p")).select("p_partkey", "p.*")
    return o.join(p, ["p_partkey", "number"], "left").where("price > 0").select("p_partkey", "number", "price", (~F.col("stock").rlike("(?i)sold out|out of stock")).alias("available"))


@query("""select p_partkey, case p_size % 3 when 0 then p_size::double when 1 then p_size + 1.0 else p_size + 2.0 end as price, greatest(p_size + 2.0, case when p_size % 2 = 0 then p_size + 9.0 else 0 end) as most from part""")
def e29_tiered_prices(spark, sf_dir):
    """The price of the first source that has one; the greatest of all, and of an advertised range."""
    z = F.col("p_size").cast("double")
    tiers = [F.when(F.col("p_size") % 3 == 0, F.array(z, z + 2)), F.when(F.col("p_size") % 3 <= 1, F.array(z + 1, z + 2)), F.array(z + 2)]
    said = money.price_range(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("AED1 - AED"), (F.col("p_size") + 9).cast("string"))).otherwise(""))
    most = F.greatest(*[F.array_max(t) for t in tiers], said["max"])
    return Tables(spark, sf_dir).part.select("p_partkey", F.coalesce(*[F.array_min(t) for t in tiers]).alias("price"), most.alias("most"))


@query("""select p_partkey, case when p_size % 2 = 0 then 11 else 2 end as sizes, case when p_size % 2 = 0 then p_size + 0.0 else null end::double as last_price from part""")
def e19_repaired_variants(spark, sf_dir):
    """Flattened variants rebuilt: a ladder from the title's ages, the greatest price on the last size; else the sizes that are there."""
    title = F.when(F.col("p_size") % 2 == 0, "Romper (3mths-8yrs)").otherwise("Romper")
    each = Tables(spark, sf_dir).part.select("p_partkey", "p_size", options.size_ladder(title).alias("ladder"))
    sizes = F.when(F.size("ladder") > 0, F.col("ladder")).otherwise(F.array(F.lit("S"), F.lit("M")))
    return each.select("p_partkey", F.size(sizes).alias("sizes"), F.when(F.size("ladder") > 0, F.col("p_size").cast("double")).alias("last_price"))
