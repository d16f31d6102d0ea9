"""Products out of pages made of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction
from .base import Tables, query


@query("""select page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) <> '' as has_title from pages""")
def e04_dom_titles(spark, sf_dir):
    """Whether a page's heading gives a title."""
    found = extraction.candidates(Tables(spark, sf_dir).pages).where("source = 'dom'")
    return found.select("page_id", (F.col("title") != "").alias("has_title"))


def _product_pages(spark, sf_dir):
    """A page for each part: JSON-LD for two of three, OpenGraph for every second, controls for all."""
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"LD '), F.col("p_name"), F.lit('","sku":"S'), n, F.lit('","offers":{"price":"'), F.col("p_size").cast("string"), F.lit('.50","priceCurrency":"AED","availability":"InStock"},}]}</script>'))
    og = F.concat(F.lit('<meta property="og:title" content="OG '), F.col("p_name"), F.lit('"><meta property="og:image" content="/i/'), n, F.lit('.jpg">'))
    body = F.concat(F.lit("<h1> DOM  "), F.col("p_name"), F.lit('</h1><select name="size"><option>Select<option>42<option data-sku="x">43</select><img src="/logo.svg"><img srcset="/a.jpg 1x, /b.jpg 2x">'))
    page = F.concat(F.when(k % 3 != 0, ld).otherwise(""), F.when(k % 2 == 0, og).otherwise(""), body)
    return Tables(spark, sf_dir).part.select(k.alias("page_id"), F.lit("https://shop.ae/p/").alias("base"), F.concat(F.lit("https://shop.ae/p/"), n).alias("url"), page.alias("html"))


@query("""select p_partkey as page_id, case when p_partkey % 3 <> 0 then 'LD ' || p_name when p_partkey % 2 = 0 then 'OG ' || p_name else 'DOM ' || p_name end as title, case when p_partkey % 3 <> 0 then 'S' || p_partkey else '' end as sku, case when p_partkey % 3 <> 0 then p_size + 0.5 end::double as price,
    case when p_partkey % 3 <> 0 then 'AED' else '' end as currency, case when p_partkey % 2 = 0 then '/i/' || p_partkey || '.jpg,https://shop.ae/i/' || p_partkey || '.jpg,' else '' end || 'https://shop.ae/b.jpg' as images, '42,43' as sizes, 2 as variants,
    20 + 20 + 10 + case when p_partkey % 3 <> 0 then 20 + 10 + 5 else 0 end as confidence from part""")
def e07_merged_products(spark, sf_dir):
    """Records merged by precedence: JSON-LD, embedded state, OpenGraph, then the page's own elements."""
    out = extraction.merged(extraction.candidates(_product_pages(spark, sf_dir)))
    return out.select("page_id", "title", "sku", "price", "currency", F.array_join("images", ",").alias("images"), F.array_join(F.col("option_values")[0], ",").alias("sizes"), F.size("variants").alias("variants"), "confidence")


@query("""select p_partkey as page_id, 2 as candidates from part where p_partkey % 3 = 0 union all select p_partkey, 3 from part where p_partkey % 3 <> 0""")
def e01_candidates(spark, sf_dir):
    """How many candidates a page has."""
    return extraction.candidates(_product_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").cast("int").alias("candidates"))
