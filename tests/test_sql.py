"""Functions under their SQL names give what their Column forms give."""

import datetime as dt

from pyspark.sql import functions as F

from millrace import sql
from millrace.functions import jsons, money, text, urls


def test_scalars(spark):
    sql.register(spark)
    texts = [None, "", "  A b﻿ c ", "Été & Cie — 12/3 ", "--x--", "<p>Hi<script>var a='<b>'</script> there</p>", "https://www.Shop.Example.com:80/a/b?q=1#t", "HTTP://x", "http://", "a.example.com/x", "http://user@h.org/%zz", "x" * 60]
    numbers = [(None, 2.0), (10.0, 10.005), (10.0, 10.02), (float("nan"), 1.0), (7.5, 0.0), (22.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([(t, a, b, dt.datetime(2024, 1 + i % 12, 1 + 3 * i % 28, 5)) for i, t in enumerate(texts) for a, b in numbers], "s string, a double, b double, at timestamp")  # noqa: DTZ001
    s, a, b = F.col("s"), F.col("a"), F.col("b")
    zero = F.lit(0.0)
    pairs = {
        "text_clean(s)": text.clean(s), "text_label(s)": text.label(s), "text_compact(s)": text.compact(s), "text_squeezed(s)": text.squeezed(s), "text_visible(s)": text.visible_text(s), "sku_token(s)": text.sku_token(s),
        "url_host(s)": urls.host(s), "url_domain(s)": urls.domain(s), "url_on_domain(s, 'example.com')": urls.on_domain(s, "example.com"), "url_is_http(s)": urls.is_http(s), "url_registrable(s)": urls.registrable(s),
        "money_close(a, b)": money.money_close(a, b), "money_source_price(a, b)": money.inferred_source_price(a, b),
        "money_by_rule(a, b, 1, 10, '.99', 5, 0)": money.price_by_rule(a, b, F.lit(1.0), F.lit(10.0), F.lit(".99"), F.lit(5.0), zero),
        "money_by_rule(a, b, 0, 0, '.00', 0, 60)": money.price_by_rule(a, b, zero, zero, F.lit(".00"), zero, F.lit(60.0)),
        "money_by_rule(a, b, 0, 0, '', 0, 0)": money.price_by_rule(a, b, zero, zero, F.lit(""), zero, zero),
        "row_fingerprint(s, a, b, s, s)": jsons.fingerprint(s, a, b, s, s), "cycle_start(at, 12)": jsons.cycle_start(F.col("at"), 12), "cycle_start(at, 31)": jsons.cycle_start(F.col("at"), 31),
    }
    assert {k.split("(")[0] for k in pairs} == {name for name, *_ in sql.SCALARS} - {"money_rounded", "money_raised", "money_capped"}  # parts of money_by_rule
    got = df.select(*[F.expr(k).alias(f"sql{i}") for i, k in enumerate(pairs)], *[c.alias(f"own{i}") for i, c in enumerate(pairs.values())]).collect()
    for i, k in enumerate(pairs):
        assert all(str(r[f"sql{i}"]) == str(r[f"own{i}"]) for r in got), (k, next((r[f"sql{i}"], r[f"own{i}"]) for r in got if str(r[f"sql{i}"]) != str(r[f"own{i}"])))
    assert "Python" not in df.select(*[F.expr(k) for k in pairs])._jdf.queryExecution().toString()


def test_tables(spark):
    sql.register(spark)
    html = """<script type="application/ld+json">{"@graph": [{"@type": "ProductGroup", "name": " A  b", "hasVariant": [{"name": "s", "sku": "1"}]}, {"@type": "Thing"}, {"@type": ["Product"], "name": "C", "image": "i.jpg"}]}</script>"""
    got = spark.sql("SELECT p.* FROM VALUES (:html), (NULL), ('') AS t(h), LATERAL jsonld_products(h) AS p", args={"html": html}).collect()
    assert [(r["pos"], r["title"], r["images"], [v["sku"] for v in r["variants"]]) for r in got] == [(0, "A b", [], ["1"]), (1, "C", ["i.jpg"], [])]
    assert spark.sql("SELECT * FROM embedded_products('<script type=\"application/json\">[{\"name\":\"x\",\"price\":2}]</script>')").first()["raw_price"] == "2"
    assert spark.sql("SELECT count(*) AS n FROM page_candidates('', '')").first()["n"] == 2
