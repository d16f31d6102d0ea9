"""Readers, sinks and extraction on small inputs."""

import io
import json
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import extraction, matching, nested, pricing, quality, sites, variants
from millrace.sources import sheets, sinks, web


def test_csv_matrix():
    text = 'a,"b, ""c""\nd"\r\n\r\nx\ry,\n \n'
    assert [c for _, c in sheets.csv_matrix(text)] == [["a", 'b, "c"\nd'], [""], ["x"], ["y", ""], [" "]]
    assert list(sheets.csv_matrix("")) == []


def test_headerless_rows(spark):
    sheets.register(spark)
    files = spark.createDataFrame([("s", ",,\n,https://x.ae/1,22,Dungarees\n24,https://x.ae/2,Shoes,DAB-NXT-A-1")], "sheet string, text string")
    got = sheets.headerless(sheets.read_matrix(files)).orderBy("row_number").collect()
    assert [(r["row_number"], r["price_multiplier"], r["collection"], r["sku"]) for r in got] == [(2, 22.0, "Dungarees", ""), (3, 24.0, "Shoes", "DAB-NXT-A-1")]
    assert spark.sql("select * from parse_csv_rows('a,b')").first()["cells"] == ["a", "b"]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>url</t></si><si><r><t>https://</t></r><r><t>x.ae</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>22</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = sheets.read_xlsx(spark, str(tmp_path / "a.xlsx")).orderBy("row_index").collect()
    assert [(r["row_index"], r["cells"]) for r in got] == [(0, ["url"]), (2, ["https://x.ae", "", "22"])]


def test_paged_source(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "title": f"t{i}"}) for i in range(123)))
    spark.dataSource.register(web.PagedCatalog)
    df = spark.read.format("paged_catalog").option("path", str(path)).option("total", 123).load()
    assert web.complete(df, 123).select("id").distinct().count() == 123
    with pytest.raises(ValueError):
        web.complete(df, 124)
    waits: list[float] = []
    with pytest.raises(OSError):
        web.retried(lambda: open("/nowhere/x"), sleep=waits.append)
    assert waits == [1, 2, 4, 8, 16, 20, 20, 20]


def test_crawl_stops_and_caps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert [(r["url"], r["depth"]) for r in web.crawl(edges, start, 5, 3).collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_guards(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(r["v"] for r in sinks.guarded_update(t, F.col("id") == 1, {"v": F.lit("z")}, 1).collect()) == ["b", "z"]
    with pytest.raises(ValueError):
        sinks.guarded_update(t, F.col("id") > 0, {"v": F.lit("z")}, 1)
    left = sinks.cascade_delete({"t": t}, spark.createDataFrame([(1,)], "k int"), {"t": "id"}, nulled=("t",))
    assert sorted(str(r["id"]) for r in left["t"].collect()) == ["2", "None"]


PRODUCT = {"@type": "Product", "name": "Test Shoe", "brand": {"name": "Acme"}, "offers": {"price": "99.50", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}, "hasVariant": [{"sku": "a", "offers": {"price": 1}}]}


def test_extraction(spark):
    page = f"""<html><head><meta property='og:image' content='/i/main.jpg'><script type="application/ld+json">{json.dumps(PRODUCT)}</script>
      <script>window.__INITIAL_STATE__ = {{"a": {{"name": "State", "price": 5, "sku": "q}}"}}}};</script></head>
      <body><img src="/logo.svg"><img src="/i/2.jpg?utm_x=1&amp;w=2#f"><label for="z">Size</label><select id="z"><option>Select</option><option>42</option><option disabled>43</option></select><button data-sku="B1">Red sold out</button></body></html>"""
    rows = spark.createDataFrame([(1, "https://x.com/p/1", page), (2, "https://x.com/2", None)], "page_id bigint, url string, html string")
    found = extraction.candidates(rows)
    assert [r["source"] for r in found.where("page_id = 1").orderBy("pos").collect()] == ["json_ld", "embedded", "open_graph", "dom"]
    got = {r["page_id"]: r for r in extraction.merged(found).collect()}
    one = got[1]
    assert (one["title"], one["price"], one["brand"], one["currency"], one["in_stock"]) == ("Test Shoe", 99.5, "Acme", "USD", True)
    assert one["images"] == ["/i/main.jpg", "https://x.com/i/main.jpg", "https://x.com/i/2.jpg?w=2"]
    assert one["option_values"][0] == ["42", "43"] and one["variants"][0]["sku"] == "a" and one["confidence"] >= 75
    assert got[2]["title"] == "" and got[2]["confidence"] == 0
    dom = found.where("page_id = 1 and source = 'dom'").first()
    assert [(v["title"], v["available"]) for v in dom["variants"]] == [("42", True), ("43", False), ("Red sold out", False)]


def test_arrow_functions(spark):
    df = spark.createDataFrame([("a &amp; b &#189;", "../x?utm_source=1&q=2", "https://h.com/a/b/c", '{"x":{"raw":{"qty":"7"}}}')], "t string, u string, b string, j string")
    got = df.select(extraction.html_unescape("t").alias("t"), extraction.url_join("u", "b").alias("u")).first()
    assert tuple(got) == ("a & b ½", "https://h.com/a/x?q=2")
    assert nested.quantities(df, "u", F.col("j")).first()["quantity"] == 7
    assert spark.range(1).select(extraction.signals(F.lit("<h1>x</h1><img src=a>"))["static"].alias("s")).first()["s"]


def units(value, depth: int = 0):
    """Depth first: own names, then containers, then near the top everything."""
    if not isinstance(value, dict | list) or depth > 4:
        return None
    held = value if isinstance(value, dict) else dict(enumerate(value))
    for v in (held.get(k) for k in nested.QUANTITY_KEYS):
        if isinstance(v, int | float) and not isinstance(v, bool):
            return max(0, math.floor(v))
        if isinstance(v, str) and re.fullmatch(r"\d+(\.\d+)?", v.strip()):
            return math.floor(float(v))
    for child in [*(held.get(k) for k in nested.CONTAINERS), *(held.values() if depth < 2 else ())]:
        if (n := units(child, depth + 1)) is not None:
            return n
    return None


def pieces(value, depth: int = 0) -> list[str]:
    if depth > 4 or value is None:
        return []
    if isinstance(value, str):
        return [p for p in (re.sub(r"\s+", " ", x).strip() for x in re.split(r"\r?\n|•|;|\|", value)) if p]
    if isinstance(value, list):
        return [p for x in value for p in pieces(x, depth + 1)]
    if isinstance(value, dict):
        named = [p for k in nested.DESCRIPTION_KEYS if k in value for p in pieces(value[k], depth + 1)]
        return named or ([p for x in value.values() for p in pieces(x, depth + 1)] if depth <= 1 else [])
    return []


def test_nested_records(spark):
    rng = random.Random(11)
    names = [*nested.QUANTITY_KEYS[:3], "qty", "raw", "product", "details", "care", "features", "b", "a"]

    def made(depth: int):
        kind = rng.random()
        if depth and kind < 0.45 or depth > 5:
            return rng.choice(["x", " 7 ", "3.5", "-2", "one; two|one", "Soft\ncotton • wash", 4, -1, 2.75, True, None, "{", ""])
        return [made(depth + 1) for _ in range(rng.randrange(3))] if kind < 0.55 else {k: made(depth + 1) for k in rng.sample(names, rng.randrange(1, 5))}

    rows = [(i, json.dumps(made(0)), rng.choice([None, "", "short", "long " * 50, " one "])) for i in range(300)] + [(900, "no json", "d"), (901, None, "d"), (902, '"text"', None)]
    df = spark.createDataFrame(rows, "i int, j string, d string")
    got = {r["i"]: r for r in nested.quantities(df, "i", F.col("j")).join(nested.enriched(df, "i", F.col("d"), F.col("j")), "i").collect()}
    for i, j, d in rows:
        record = json.loads(j) if i not in (900, 901) else None
        found = [p for p in dict.fromkeys(pieces(record)) if len(p) >= 3]
        base = re.sub(r"\s+", " ", d or "").strip()
        full = (base or None) if not found else "\n".join(found[:20]) if not base else base if len(base) >= 180 else "\n".join(list(dict.fromkeys([base, *found]))[:24])
        assert (got[i]["quantity"], got[i]["description"]) == (units(record), full), (j, d)


def test_storefront_record(spark):
    record = {
        "sku": "123", "name": " Cotton  dress ", "inStock": True, "images": [{"url": "https://h.com/1.jpg"}, {"url": "rel.jpg"}],
        "attributes": [{"name": "assets_pdp", "value": json.dumps([{"url": "https://h.com/2.jpg"}, {"url": "https://h.com/1.jpg"}, {"url": "x", "styles": {"product_zoom_large_800x800": "https://h.com/3.jpg"}}])}, {"name": "assets_plp", "value": "no list"}, {"name": "Color", "value": "Dark blue"}],
        "options": [{"id": "SIZE", "values": [{"title": "S "}, {"value": "EU 36", "inStock": True}, {"title": "L", "inStock": False}, {"title": "S"}]}],
        "price": {"regular": {"amount": {"value": 90, "currency": "SAR"}}}, "priceRange": {"minimum": {"final": {"amount": {"value": 0}}}, "maximum": {"final": {"amount": {"value": 120.5}}}},
    }
    url = "https://www2.hm.com/en/productpage.0777.html"
    rows = [(1, json.dumps(record)), (2, json.dumps(record | {"inStock": False, "options": [], "attributes": None})), (3, "{}"), (4, None), (5, "broken")]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, j string").select("i", sites.storefront(F.col("j"), F.lit(url)).alias("p")).collect()}
    one = got[1]
    assert (one["id"], one["title"], one["color"], one["price"], one["most"], one["currency"], one["sizes"]) == ("123", "Cotton dress", "Dark blue", 90.0, 120.5, "SAR", ["S", "EU 36"])
    assert one["images"] == ["https://h.com/1.jpg", "https://h.com/2.jpg", "https://h.com/3.jpg"]
    assert [(v["id"], v["sku"], v["color"], v["price"], v["available"]) for v in one["variants"]] == [("123-s", "123-S", "Dark blue", 90.0, True), ("123-eu-36", "123-EU-36", "Dark blue", 90.0, True)]
    assert got[2]["variants"] == [] and got[2]["color"] is None and not got[2]["in_stock"]
    assert all(got[i]["price"] is None and got[i]["sizes"] == [] and got[i]["images"] == [] for i in (3, 4, 5))


def test_restrictions(spark):
    found = quality.restrictions(F.lit("Verify you are human. Cloudflare. Too many requests."), F.lit(429))
    got = spark.range(1).select(*[c.alias(k) for k, c in found.items()], quality.warning_code(found).alias("code")).first()
    assert got["captcha"] and got["bot"] and got["rate"] and not got["geo"] and got["code"] == "CAPTCHA_DETECTED"


def test_sync_gate(spark):
    v = lambda sku, price, size: F.struct(F.lit(sku).alias("sku"), F.lit(price).alias("price"), F.lit("red").alias("color"), F.lit(size).alias("size"), F.lit(None).cast("map<string,string>").alias("options"))
    gate = lambda m=22, price=50.0, text="fine", vs=(v("a", 10.0, "S"), v("b", 20.0, "M")), image="https://x/1.jpg": quality.sync_gate(F.lit(m), F.lit("AED"), F.lit(price), F.lit("Title"), F.lit(text), F.array(F.lit(image)), F.array(*vs))
    cases = {
        None: gate(), "Product has no approved sheet multiplier": gate(21), "Fresh source failed the strict catalog quality gate": gate(price=1.0), "Suspicious source image rejected": gate(image="https://x/logo.png"),
        "Fresh source has empty or duplicate deterministic SKUs": gate(vs=(v("a", 1.5, "S"), v("A ", 2.0, "M"))), "Fresh source title or description contains executable markup": gate(text="x <script>y"),
        "Fresh source contains an implausible or missing AED variant price": gate(vs=(v("a", 1.0, "S"),)), "Fresh source variant price spread is implausibly large": gate(vs=(v("a", 2.0, "S"), v("b", 20.0, "M"))),
        "Fresh source contains a suspicious color or size value": gate(vs=(v("a", 2.0, "AED 5"),)), "Fresh multi-variant source contains a placeholder option value": gate(vs=(v("a", 2.0, "Default"), v("b", 3.0, "M"))),
    }
    got = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cases.values())]).first()
    assert list(got) == list(cases)


def test_dedupe_any_key(spark):
    rows = [(1, 0, "s1", "k1", ""), (1, 1, "s2", "k1", "v9"), (1, 2, "s3", "k3", "v9"), (1, 3, "s3", "", ""), (1, 4, "s4", "", "")]
    df = spark.createDataFrame(rows, "p int, i int, signature string, sku string, source_id string")
    assert sorted(r["i"] for r in variants.dedupe_rows(df, "p", "i", ["signature", "sku", "source_id"]).collect()) == [0, 2, 4]
    each = df.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "signature", "sku", "source_id"))).alias("v"))
    assert [x["i"] for x in each.select(variants.dedupe_in_row(F.col("v")).alias("k")).first()["k"]] == [0, 2, 4]


def test_pricing_falls_back_to_all_rules(spark):
    items = spark.createDataFrame([("s1", "AED"), ("s2", "EUR")], "supplier_id string, currency string")
    rules = spark.createDataFrame([(1, "s1", None, False), (2, "s3", "AED", True)], "rule_pos int, supplier_id string, currency string, is_default boolean")
    got = {r["supplier_id"]: (r["rule_pos"], r["eligible"]) for r in pricing.best(items, rules).collect()}
    assert got == {"s1": (1, True), "s2": (1, False)}


def test_cascade_gives_each_product_one_status(spark):
    products = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "product int, has_explicit_url boolean")
    schema = "product int, method string, canonical string, exact_sku int, priority int, row_number int"
    evidence = spark.createDataFrame([(1, "exact_sku", "u1", 0, 1, 9), (1, "source_url", "u1", 1, 0, 5), (2, "exact_sku", "u1", 0, 0, 1), (2, "exact_sku", "u2", 0, 0, 2)], schema)
    titles = spark.createDataFrame([(1, "source_url_title", "u7", 1, 0, 1)], schema)
    got = {r["product"]: (r["status"], r["method"], r["row_number"]) for r in matching.cascade(products, evidence, titles).collect()}
    assert got == {1: ("matched", "source_url", 9), 2: ("needs_review", "ambiguous", None), 3: ("needs_review", "source_url_not_in_sheets", None), 4: ("needs_link", "none", None)}
