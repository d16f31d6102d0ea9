"""Whole products from the records of one kind of site: a shop's storefront API with attributes, options and price ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import options, text, urls
from .records import first_of

_AMOUNT = "struct<amount:struct<value:double,currency:string>>"
_PRICE = f"struct<final:{_AMOUNT},regular:{_AMOUNT}>"
STOREFRONT = (
    "sku string, name string, description string, inStock boolean, images array<struct<url:string,label:string>>, attributes array<struct<name:string,label:string,value:string>>, "
    f"options array<struct<id:string,title:string,values:array<struct<title:string,value:string,inStock:boolean>>>>, price {_PRICE}, priceRange struct<minimum:{_PRICE},maximum:{_PRICE}>"
)
# Attributes that name a colour, and those that list further images, in their order.
COLOR_ATTRIBUTES, IMAGE_ATTRIBUTES = ("color_label", "actual color label", "colour", "color"), ("assets_pdp", "assets_plp", "assets_cart")
_ASSETS = "array<struct<url:string,styles:struct<product_zoom_large_800x800:string>>>"


def storefront(record: Column, url: Column) -> Column:
    """struct<id,title,description,color,price,most,currency,images,sizes,in_stock,variants> of a record of JSON text.

    The price is the least above 0 of the plain price and the range's ends, `most` the greatest. The colour is the first
    attribute that names one; images are the record's own, then those that attributes list, whole and each once. Sizes
    that are in stock make the variants, each with a code of its own; without any there are none. The record's stock is
    that of all variants. A text that is no record gives nulls and empty lists.
    """
    return F.get(F.transform(F.array(F.from_json(record, STOREFRONT)), lambda r: _storefront(r, url)), F.lit(0))  # parsed once


def _storefront(r: Column, url: Column) -> Column:
    none = F.array().cast("array<string>")
    amount = lambda p: F.coalesce(p["final"]["amount"]["value"], p["regular"]["amount"]["value"])
    currency = lambda p: F.coalesce(p["final"]["amount"]["currency"], p["regular"]["amount"]["currency"])
    places = [r["priceRange"]["minimum"], r["priceRange"]["maximum"], r["price"]]
    prices = F.filter(F.array(*map(amount, places)), lambda p: p > 0)
    colors = F.filter(r["attributes"], lambda a: F.lower(text.clean(a["name"])).isin(*COLOR_ATTRIBUTES) | F.lower(text.clean(a["label"])).isin(*COLOR_ATTRIBUTES))
    color = F.nullif(options.color_value(F.get(F.transform(colors, lambda a: a["value"]), F.lit(0))), F.lit(""))
    listed = lambda name: F.coalesce(F.from_json(F.get(F.transform(F.filter(r["attributes"], lambda a: text.clean(a["name"]) == name), lambda a: a["value"]), F.lit(0)), _ASSETS), F.array().cast(_ASSETS))
    further = [F.transform(listed(name), lambda x: F.coalesce(F.nullif(x["styles"]["product_zoom_large_800x800"], F.lit("")), x["url"])) for name in IMAGE_ATTRIBUTES]
    images = F.array_distinct(F.filter(F.concat(F.coalesce(F.transform(r["images"], lambda i: i["url"]), none), *further), urls.is_http))
    named = F.filter(r["options"], lambda o: (text.label(o["id"]) == "size") | (text.label(o["title"]) == "size"))
    values = F.coalesce(F.get(F.transform(named, lambda o: o["values"]), F.lit(0)), F.array().cast("array<struct<title:string,value:string,inStock:boolean>>"))
    sizes = F.array_distinct(F.filter(F.transform(F.filter(values, lambda v: F.coalesce(v["inStock"], F.lit(True))), lambda v: first_of(v["title"], v["value"])), lambda x: x != ""))
    in_stock = F.coalesce(r["inStock"], F.lit(True))
    variants = F.transform(
        sizes,
        lambda s: F.struct(
            F.concat_ws("-", text.clean(r["sku"]), F.lower(text.sku_token(s))).alias("id"), F.concat_ws("-", text.clean(r["sku"]), text.sku_token(s)).alias("sku"), color.alias("color"), s.alias("size"), F.array_min(prices).alias("price"), in_stock.alias("available")
        ),
    )
    return F.struct(
        F.coalesce(F.nullif(text.clean(r["sku"]), F.lit("")), urls.product_code(url)).alias("id"), text.clean(r["name"]).alias("title"), text.clean(r["description"]).alias("description"), color.alias("color"), F.array_min(prices).alias("price"), F.array_max(prices).alias("most"),
        F.coalesce(*map(currency, places), urls.currency(url)).alias("currency"), images.alias("images"), sizes.alias("sizes"), in_stock.alias("in_stock"), variants.alias("variants"),
    )
