"""What site parsers share, as functions of the JSON records and markdown pages that sites serve.

Records come as JSON texts or typed columns; each function states the form that it reads. Arrays are those of one
record, so they are bounded by it; nothing here shuffles but `nested`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsons, money, options, text, urls
from . import extraction, quality

#: Parts of hosts in the order in which their parsers are asked.
PARSERS = ("next.", "gap.", "marksandspencer", "mothercare", "zara", "lefties", "shein", "maxfashion", "centrepoint", "hm.com", "adidas")


def first_of(*values: Column) -> Column:
    """The first value that is not empty, cleaned."""
    return F.coalesce(*[F.nullif(text.clean(v), F.lit("")) for v in values], F.lit(""))


def parser_of(url: Column) -> Column:
    """The first parser that a URL's host fits, else the generic one."""
    host, out = F.coalesce(urls.host(url), F.lit("")), F.lit("generic")
    for name in reversed(PARSERS):
        out = F.when(F.contains(host, F.lit(name)), name).otherwise(out)
    return out


def judged(title: Column, price: Column, raw_price: Column, currency: Column, description: Column, images: Column, variants: Column, skus: Column) -> Column:
    """struct<confidence,warnings,valid> of a record; images and variants say how many, skus lists the variants' codes."""
    sure = money.confidence({"title": text.clean(title) != "", "price": price.isNotNull(), "images": images > 0, "description": text.clean(description) != "", "variants": variants > 0, "json_ld": F.lit(False), "canonical": F.lit(False), "identity": F.size(skus) > 0})
    codes = quality.extraction_warnings(title, price, images, variants, F.lit(0), raw_price, currency, skus, sure)
    return F.struct(sure.alias("confidence"), codes.alias("warnings"), ((text.clean(title) != "") & F.coalesce(price >= 0, F.lit(False))).alias("valid"))


def normalised(variants: Column) -> Column:
    """array<struct<color,size>>: defaults choose nothing, and a variant without a value inherits an option's only one."""
    plain = lambda v: F.when(options.is_default(v), "").otherwise(text.clean(v))
    chosen = F.transform(variants, lambda v: F.struct(plain(v["color"]).alias("color"), plain(v["size"]).alias("size")))
    known = lambda name: F.array_distinct(F.filter(F.transform(chosen, lambda v: v[name]), lambda x: x != ""))
    own = lambda v, name: F.when((v[name] == "") & (F.size(known(name)) == 1), known(name)[0]).otherwise(v[name]).alias(name)
    return F.transform(chosen, lambda v: F.struct(own(v, "color"), own(v, "size")))


def nested(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """key, variants: stored rows as one nested product each, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("variants"))


def generic_product(ld: Column, page: Column) -> Column:
    """struct<title,price,variants> of a page that no site parser knows.

    ld: struct<name,offers:array<struct<price:string,sku>>>; page: struct<og_title,dom_title,price,colors,sizes>. Each
    field comes from the first source that has it. More than one offer makes the variants, else the matrix of colours
    and sizes does, else there is a single default one.
    """
    offers = F.coalesce(ld["offers"], F.array().cast("array<struct<price:string,sku:string>>"))
    own = F.try_element_at(F.filter(F.transform(offers, lambda o: money.localized_money(o["price"])), lambda p: p > 0), F.lit(1))
    colors, sizes = (F.array_distinct(F.coalesce(page[n], F.array().cast("array<string>"))) for n in ("colors", "sizes"))
    matrix = F.greatest(F.size(colors), F.lit(1)) * F.greatest(F.size(sizes), F.lit(1))
    n = F.when(F.size(offers) > 1, F.size(offers)).when(matrix > 1, matrix).otherwise(1)
    return F.struct(first_of(ld["name"], page["og_title"], page["dom_title"]).alias("title"), F.coalesce(own, F.nullif(money.localized_money(page["price"]), F.lit(0.0))).alias("price"), n.alias("variants"))


def sibling_variants(products: Column, url: Column, code: Column) -> Column:
    """Of array<struct<url,sku,...>> those of the page and the code's prefix, each SKU once, the first."""
    same = F.filter(products, lambda p: (urls.canonical_source(p["url"]) == urls.canonical_source(url)) & p["sku"].startswith(code))
    skus = F.transform(same, lambda p: p["sku"])
    return F.filter(same, lambda p, i: F.array_position(skus, p["sku"]) == i + 1)


def two_level_rows(groups: Column, flat: Column) -> Column:
    """Rows of array<struct<skus:array<row>>>, or the flat list where there are none; rows get `can_order`.

    row: struct<id,orderable,available>; the first flag that is there decides, and without one it can be ordered.
    """
    deep = F.flatten(F.transform(groups, lambda g: g["skus"]))
    rows = F.when(F.coalesce(F.size(deep), F.lit(0)) > 0, deep).otherwise(flat)
    return F.transform(rows, lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["orderable"], r["available"], F.lit(True)).alias("can_order")))


def sizes_of(said: Column, title: Column, picker: Column) -> Column:
    """Sizes that are spelled out, else a ladder from the title's ages, else S, M, L for slippers with a picker."""
    ladder = options.size_ladder(title)
    slippers = F.when(picker & title.rlike("(?i)slipper"), F.array(F.lit("S"), F.lit("M"), F.lit("L"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(said) > 0, said).when(F.size(ladder) > 0, ladder).otherwise(slippers)


def option_labels(raw: Column) -> Column:
    """map "attribute/code" -> label of a JSON list of attributes with their values."""
    parsed = F.from_json(raw, "array<struct<attribute:string,values:array<struct<code:string,label:string>>>>")
    pairs = F.flatten(F.transform(parsed, lambda a: F.transform(a["values"], lambda v: F.struct(F.concat_ws("/", a["attribute"], v["code"]).alias("k"), v["label"].alias("v")))))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def in_stock(managed: Column, online: Column, behaviour: Column) -> Column:
    """By count where stock is managed, else unless the behaviour hides the product."""
    return F.when(managed, online > 0).otherwise(behaviour != "HideProduct")


def snapshot_gate(url: Column, product_id: Column, price: Column, title: Column, images: Column, skus: Column) -> Column:
    """The first gate that a pasted snapshot fails; null if it may be used."""
    return quality.first_issue([
        (product_id != urls.product_code(url), "snapshot is of another product"),
        (F.when(price.contains("AED"), money.localized_money(price)).otherwise(0.0) <= 0, "no AED price"),
        (text.clean(title) == "", "no title"),
        (~F.exists(images, urls.is_http), "no image"),
        (~F.exists(skus, lambda s: s != ""), "no size with a SKU"),
    ])


def in_english(attributes: Column) -> Column:
    """The English value of array<struct<lang,value>>, else the first."""
    return F.coalesce(F.try_element_at(F.filter(attributes, lambda a: a["lang"] == "en"), F.lit(1)), F.try_element_at(attributes, F.lit(1)))["value"]


def first_color(candidates: Column) -> Column:
    """The first candidate that is a colour; null for none."""
    return F.try_element_at(F.filter(F.transform(candidates, options.color_value), lambda c: c != ""), F.lit(1))


def by_number(images: Column) -> Column:
    """Image URLs in order of the number that ends their file name, those without one last."""
    number = lambda u: F.coalesce(F.regexp_extract(u, r"(\d{1,9})\.\w+$", 1).try_cast("int"), F.lit(1 << 30))
    return F.transform(F.array_sort(F.transform(images, lambda u: F.struct(number(u).alias("n"), u.alias("u")))), lambda s: s["u"])


def attribute(attributes: Column, *names: str) -> Column:
    """The value of the first of array<struct<name,value>> with one of the names."""
    return F.try_element_at(F.filter(attributes, lambda a: F.lower(a["name"]).isin(*names)), F.lit(1))["value"]


def price_or_range(simple: Column, spread: Column) -> Column:
    """A plain positive price, else the least of a range's text."""
    own, least = simple.try_cast("double"), F.array_min(F.filter(money.simple_prices(spread), lambda p: p > 0))
    return F.coalesce(F.when(own > 0, own), least)


def overlaid(record: Column, fallback: Column) -> Column:
    """struct<title,sizes,least,most> of an API record over a fallback, both struct<title,prices,sizes:array<struct<size,stock>>>.

    Fields that the record leaves empty come from the fallback; sold-out sizes go; least and most are of the prices above 0.
    """
    rows = lambda name: F.when(F.size(record[name]) > 0, record[name]).otherwise(fallback[name])
    prices = F.filter(rows("prices"), lambda p: p > 0)
    left = F.transform(F.filter(rows("sizes"), lambda s: s["stock"] > 0), lambda s: s["size"])
    return F.struct(first_of(record["title"], fallback["title"]).alias("title"), left.alias("sizes"), F.array_min(prices).alias("least"), F.array_max(prices).alias("most"))


def size_attribute(values: Column, flag: Column) -> Column:
    """struct<sizes,available> of array<struct<value,selectable>>: available by the flag, or if any can be selected."""
    return F.struct(F.transform(values, lambda v: v["value"]).alias("sizes"), (F.coalesce(flag, F.lit(False)) | F.exists(values, lambda v: F.coalesce(v["selectable"], F.lit(False)))).alias("available"))


def colorways(markdown: Column, style: Column, current: Column, price: Column) -> Column:
    """array<struct<id,price>> of a style's cards in a markdown page, the current one first and each once.

    A card is a link to /style/<style>/<id>; its price follows on its line, else it is that of the page.
    """
    lines = F.filter(F.split(text.text(markdown), "\n"), lambda x: F.contains(x, F.concat(F.lit("](/style/"), style, F.lit("/"))))
    cards = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"\]\(/style/\w+/(\w+)\)", 1).alias("id"), money.localized_money(F.regexp_extract(x, r"\)([^)]*)$", 1)).alias("price"), i.alias("pos")))
    cards = F.filter(cards, lambda c: c["id"] != "")
    ranked = F.array_sort(F.transform(cards, lambda c: F.struct((c["id"] != current).alias("late"), c["pos"].alias("pos"), c["id"].alias("id"), c["price"].alias("price"))))
    ids = F.transform(ranked, lambda c: c["id"])
    once = F.filter(ranked, lambda c, i: F.array_position(ids, c["id"]) == i + 1)
    return F.transform(once, lambda c: F.struct(c["id"].alias("id"), F.when(c["price"] > 0, c["price"]).otherwise(price).alias("price")))


def state_variants(variants: Column, labels: Column, default_color: Column) -> Column:
    """array<struct<size,color,can_order>> of a state object's variants, by their option's display order.

    variants: array<struct<option,color,order,available,in_stock>>; labels: map option id -> label. A missing order is 0,
    a missing colour the default one; the first flag that is there decides, without one it can be ordered.
    """
    rows = F.transform(variants, lambda v, i: F.struct(
        F.coalesce(v["order"], F.lit(0)).alias("order"), i.alias("pos"), F.try_element_at(labels, v["option"]).alias("size"),
        first_of(v["color"], default_color).alias("color"), F.coalesce(v["available"], v["in_stock"], F.lit(True)).alias("can_order"),
    ))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["size"].alias("size"), r["color"].alias("color"), r["can_order"].alias("can_order")))


@F.pandas_udf(T.StringType())
def assigned(script: pd.Series, names: pd.Series) -> pd.Series:
    """The JSON that a script assigns to the first of its window variables (names, by bars) that it has; null without one."""

    def found(source: str, wanted: str) -> str | None:
        for name in wanted.split("|"):
            at = source.find(f"window.{name}")
            if at >= 0 and (value := extraction.balanced(source, at)):
                return value
        return None

    return pd.Series([found(s or "", n) for s, n in zip(script, names, strict=True)], dtype=object)


def goods(raw: Column) -> Column:
    """struct<title,sold_out> of a script's JSON: by the first path that is there; sold out if stock, status or on-sale is 0."""
    v = jsons.parsed(raw)
    get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    zero = lambda *paths: F.coalesce(get(*paths) == "0", F.lit(False))
    sold = zero("$.stock", "$.goods.stock") | zero("$.status", "$.goods.status") | zero("$.goods.on_sale")
    return F.struct(get("$.title", "$.goods.name").alias("title"), sold.alias("sold_out"))


def markdown_product(page: Column) -> Column:
    """struct<title,price,sizes,images> of a page as markdown.

    The title is the first heading's, else that of a Title line; the price is the last with a currency before the VAT
    line, or in the page without one; sizes stand between a Size line and the next section; images are those of products.
    """
    title = first_of(F.regexp_extract(page, r"(?m)^# (.*)$", 1), F.regexp_extract(page, r"(?m)^Title: (.*)$", 1))
    images = F.filter(F.regexp_extract_all(text.text(page), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), urls.is_product_image)

    def read(lines: Column) -> Column:
        before = text.once(place(lines, "(?i)vat$"), lambda vat: F.when(vat > 0, F.slice(lines, F.lit(1), F.greatest(vat - 1, F.lit(0)))).otherwise(lines))
        price = F.try_element_at(F.filter(before, lambda x: x.rlike(r"(?:AED|USD|EGP)\s*\d")), F.lit(-1))
        sizes = window_after(lines, "(?i)^sizes?$", "(?i)^(?:overview|description|details|add to )")
        return F.struct(title.alias("title"), money.localized_number(price).alias("price"), sizes.alias("sizes"), images.alias("images"))

    return text.once(lines_of(page), read)


def lines_of(page: Column) -> Column:
    """A page's lines, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(text.text(page), "\n"), text.clean), lambda x: x != "")


def place(lines: Column, pattern: str) -> Column:
    """The place (from 1) of the first line that a pattern fits; 0 for none."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")


def window_after(lines: Column, marker: str, stop: str, most: int = 60) -> Column:
    """Lines after the first that fits the marker, up to one that fits the stop or `most`; none without the marker."""
    after = text.once(place(lines, marker), lambda at: F.when(at > 0, F.slice(lines, at + 1, F.lit(most))).otherwise(F.array().cast("array<string>")))
    cut = lambda rest: text.once(place(rest, stop), lambda end: F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest))
    return text.once(after, cut)


def snapshot(lines: Column, picker: str = "(?i)^choose a size$", price: str = r"^AED\s*\d", stop: str = "(?i)^(?:details|description|delivery)$") -> Column:
    """struct<title,price,sizes,rejected> of a pasted page: the title stands before the price line, sizes after the picker.

    A page with a picker but no sizes is rejected, as is one without a price.
    """
    at, sizes = place(lines, price), window_after(lines, picker, stop)
    rejected = F.when(at == 0, "no price").when((place(lines, picker) > 0) & (F.size(sizes) == 0), "a size picker without sizes")
    return F.struct(F.when(at > 1, F.get(lines, at - 2)).alias("title"), money.localized_number(F.when(at > 0, F.get(lines, at - 1))).alias("price"), sizes.alias("sizes"), rejected.alias("rejected"))


def merged_options(options: Column) -> Column:
    """array<struct<name,values>> of array<struct<id,name,label,order>>: merged by name in order of appearance, each
    name's labels once, by display order (a missing one is 0), then as they come."""
    names = F.array_distinct(F.transform(options, lambda o: o["name"]))

    def values(name: Column) -> Column:
        own = F.filter(F.transform(options, lambda o, i: F.struct(F.coalesce(o["order"], F.lit(0)).alias("order"), i.alias("pos"), o["name"].alias("name"), o["label"].alias("label"))), lambda o: o["name"] == name)
        return F.array_distinct(F.transform(F.array_sort(own), lambda o: o["label"]))

    return F.transform(names, lambda n: F.struct(n.alias("name"), values(n).alias("values")))
