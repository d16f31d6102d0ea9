"""Queries written as SQL text, over the functions that the engine registers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import sql
from .base import Tables, query


def _run(spark, sf_dir, text: str, *tables: str) -> DataFrame:
    """A query's text over views of the tables, with all functions registered."""
    sql.register(spark)
    t = Tables(spark, sf_dir)
    return spark.sql(text, **{name: getattr(t, name) for name in tables})


@query("""select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as domain, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) like '%.example.com' as com, url is not null as http from pages""")
def q_sql_page_domains(spark, sf_dir):
    """URL functions in SQL text."""
    return _run(spark, sf_dir, "SELECT page_id, url_domain(url) AS domain, url_on_domain(url, 'example.com') AS com, url_is_http(url) AS http FROM {pages}", "pages")


@query("""select upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) as vendor, lower(p_type) as label, count(*) as n, min(substr(upper(replace(p_name, ' ', '-')) || '-' || p_partkey, 1, 24)) as first_sku,
    sum(case when abs(p_retailprice - round(p_retailprice, 1)) < 0.01 then 1 else 0 end)::bigint as close from part group by 1, 2""")
def q_sql_catalog_labels(spark, sf_dir):
    """Normalisers as grouping keys and inside aggregates, in SQL text."""
    return _run(
        spark, sf_dir,
        """SELECT text_compact(p_brand) AS vendor, text_label(concat('  ', p_type, ' ')) AS label, count(*) AS n, min(sku_token(concat(p_name, ' / ', p_partkey))) AS first_sku,
        sum(CASE WHEN money_close(p_retailprice, round(p_retailprice, 1)) THEN 1 ELSE 0 END) AS close FROM {part} GROUP BY 1, 2""", "part",
    )


@query("""select p_partkey, p_name as title, 'S' || p_partkey as sku, p_size::varchar as raw_price, p_size % 2 = 0 as in_stock, p_size % 3 as variants, p_brand as embedded from part""")
def q_sql_page_products(spark, sf_dir):
    """Products of pages through table functions in SQL text: one JSON-LD product and one node of embedded state a page."""
    text = """WITH pages AS (SELECT p_partkey, concat('<script type="application/ld+json">', to_json(named_struct('@type', 'Product', 'name', p_name, 'sku', concat('S', p_partkey),
        'offers', named_struct('price', p_size, 'availability', CASE WHEN p_size % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END), 'hasVariant', transform(sequence(0, p_size % 3), i -> named_struct('name', concat('v', i))))),
        '</script><script id="__NEXT_DATA__">', to_json(named_struct('a', named_struct('title', p_brand, 'price', 1))), '</script>') AS html FROM {part})
        SELECT p_partkey, j.title, j.sku, j.raw_price, j.in_stock, size(j.variants) - 1 AS variants, e.title AS embedded FROM pages, LATERAL jsonld_products(html) AS j, LATERAL embedded_products(html) AS e"""
    return _run(spark, sf_dir, text, "part")


@query("""select o_orderkey, sum(case when m then 1 else 0 end)::bigint as matching, count(*) as n from (select o_orderkey, l.l_quantity = 10 as m from orders join lineitem l on l.l_orderkey = o_orderkey where o_orderstatus = 'P') group by 1""")
def q_sql_csv_lines(spark, sf_dir):
    """CSV texts, one an order, read back with a table function in SQL text."""
    text = """WITH files AS (SELECT o_orderkey, array_join(collect_list(concat('"a ""q""', o_orderkey, '",', CAST(l_quantity AS INT))), chr(10)) AS text FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT o_orderkey, count_if(r.cells[1] = '10') AS matching, count(*) AS n FROM files, LATERAL parse_csv_rows(text) AS r GROUP BY 1"""
    return _run(spark, sf_dir, text, "orders", "lineitem")
