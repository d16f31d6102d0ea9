"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsons, money, options, text, urls


@pytest.fixture(scope="module")
def of(spark):
    """The value of a column expression over one row."""
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


s = F.lit


@pytest.mark.parametrize(("given", "amount", "currency"), [("$1,299.99", 1299.99, "USD"), ("€1.299,99", 1299.99, "EUR"), ("١٢٥٠ ج.م", 1250.0, "EGP"), ("AED 250", 250.0, "AED"), ("1,299", 1299.0, None), ("12,5", 12.5, None), ("none", None, None)])
def test_prices(of, given, amount, currency):
    assert of(money.localized_number(s(given))) == amount
    assert of(money.currency(s(given))) == currency


def test_more_money(of):
    assert of(money.localized_money(s("was 0, now ٩٩٫٥ AED"))) == 99.5
    assert tuple(of(money.price_range(s("AED92 - AED114")))) == (92.0, 114.0)
    assert of(money.cents_price(s("2599"))) == 25.99
    assert [of(money.js_to_fixed2(s(x))) for x in (1.005, 2.675, 1.115, -1.5)] == [1.0, 2.67, 1.11, -1.5]
    assert of(money.js_round(s(-2.5))) == -2 and of(money.js_round(s(2.5))) == 3
    assert [of(money.positive(s(x))) for x in ("", " 5 ", "0x1f", "-1", "x")] == [None, 5.0, 31.0, None, None]
    assert of(money.currency_regional(s("USD or EGP"))) == "EGP"


def test_text(of):
    assert of(text.clean(s(" a  b\n﻿ c "))) == "a b c"
    assert of(text.base_title(s("Baby Romper – Size 3-6 months"))) == "baby romper"
    assert of(text.base_title(s("Cosy Cardigan (Size: 2)"))) == "cosy cardigan"
    assert of(text.title_link(s("Tom &amp; Jerry &#189; set"))) == "tom and jerry half set"
    assert of(text.title_relation(s("Shirt (3-6 months) - Size XL"))) == "shirt"
    assert of(text.vendor_catalog(s("H&M"))) == "HM" and of(text.vendor_relation(s("Marks & Spencer UAE"))) == "marksandspencer"
    assert of(text.contains_label(s("navy blue"), s("Blue"))) and not of(text.contains_label(s("bluest"), s("blue"))) and not of(text.contains_label(s("x"), s("")))
    assert of(text.collection(s(""), s("/mens-shirts/1"))) == "Tops & T-shirts" and of(text.collection(s(" Pyjama "))) == "Pyjamas & Homewear" and of(text.collection(s(None))) == "General"
    assert of(text.row_number_in(s("bad price in row 17"))) == 17


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://M.Shop.ae/En/P/X1/?utm_source=a&ref=b&c=1#t", "https://www.shop.ae/en/p/x1?c=1"),
        ("https://shop.ae/", "https://shop.ae"),
        ("https://shop.ae/?reference=1),", "https://shop.ae"),
        (" Not a URL/ ", "not a url"),
        ("https://shop.ae:443/a", "https://shop.ae/a"),
        ("http://shop.ae:8080/?c=2", "http://shop.ae:8080/?c=2"),
    ],
)
def test_canonical(of, given, want):
    assert of(urls.canonical_link(s(given))) == want
    assert of(urls.canonical_link(s(want))) == want


def test_urls(of):
    assert of(urls.canonical_source(s("https://Shop.ae/En/x/?a=1#b"))) == "https://shop.ae/En/x"
    assert of(urls.sheet_export(s("https://docs.google.com/spreadsheets/d/abc/edit#gid=93159589"))) == "https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=93159589"
    assert of(urls.brand_code(s("https://www.next.ae/en/style/abc"))) == "NXT" and of(urls.region(s("https://www.next.ae/en/style/abc"))) == "ME"
    assert of(urls.sku_prefixes(s("dab-nxt-w90-031-s-22"))) == ["DAB-NXT-W90-", "DAB-NXT-W90-031-"]
    assert of(urls.identifiers(s("https://x.ae/style/st1/W90031?v1=ab12345"))) == ["W90031", "AB12345"]
    assert of(urls.sku_identifiers(s("W90031-OPTION-1"), s("Next"))) == ["W90031"]
    assert of(urls.is_product_image(s("https://x/logo.svg"))) is False
    kinds = [("/p/abc", "product"), ("/category/dresses", "category"), ("/cart", "ignored"), ("/a.png", "asset"), ("/about", "page")]
    assert [of(urls.page_type(s(f"https://x.com{p}"))["type"]) for p, _ in kinds] == [k for _, k in kinds]


def test_options(of):
    sizes = {"3 - 6 Months": "3-6M", "Up to 1 month": "UP-TO-1M", "EU 22 / UK 5.5": "EU-22-UK-5.5", "50 cm (7 lb)": "50CM-7LB", "New Born": "NB", "2 Years": "2Y", "one size": "ONE", "weird": None, "Default": None}
    assert {k: of(options.size_token(s(k))) for k in sizes} == sizes
    assert of(options.size_token(s("weird one!"), True)) == "WEIRD-ONE" and of(options.size_token(s("XL"), True)) == "XL"
    assert [of(options.size_rank_sku(s(x))) for x in ("NB", "UP-TO-3M", "1P5Y", "M", "ONE", "?")] == [-100.0, 3.0, 18.0, 2030.0, 5000.0, 3000.0]
    assert of(options.hex_color(s("rgb(255, 0, 10)"))) == "#FF000A" and of(options.hex_color(s("#abc"))) == "#AABBCC" and of(options.hex_color(s("Navy"))) == "#000080" and of(options.hex_color(s("rgba(1,1,1,0)"))) == ""
    assert [of(options.looks_like_size(s(x))) for x in ("XL", "3-6 months", "EU 22", "red", "5", "Baby Girl 3 months")] == [True, True, True, False, False, False]
    ladder = of(options.size_ladder(s("Romper (3mths-8yrs)")))
    assert len(ladder) == 11 and ladder[0].startswith("3-6 Months") and ladder[-1].startswith("7-8 Years")
    assert of(options.title_color(s("Navy Blue T-Shirt from Next"))) == "Navy Blue" and of(options.title_color(s("Baby Dress"))) is None
    assert of(options.product_code(s("https://www.next.ae/en/style/st12/W90031"), s(""))) == "W90-031"
    assert of(options.base_sku(s("NXT"), s("W90-031"), s("S"), s(22))) == "DAB-NXT-W90-031-S-22"
    assert len(of(options.bounded_code(s("A" * 40), s("id")))) == 26
    assert of(options.option_names(F.array(s("Fit"), s("Size"), s("Colour"), s("X")))) == ["Color", "Size", "Fit"]
    assert of(options.value_in_title(s("Dress navy blue XL"), F.array(s("blue"), s("navy blue"), s("green")))) == "navy blue"
    assert of(options.labelled(s("Selected colour: Dark Red size M"), "Color")) == "Dark Red"


def test_json(of):
    assert of(F.to_json(jsons.parsed(s('<!-- {"a":[1,2,],} -->')))) == '{"a":[1,2]}' and of(jsons.parsed(s("{")).isNull())
    assert of(jsons.merged(s('{"a":"1","b":"2"}'), s('{"b":null,"c":"3"}'))) == '{"a":"1","b":"2","c":"3"}'
    assert of(jsons.as_list(s('["a"," b ",""]'))) == ["a", "b"] and of(jsons.as_list(s("a, b|c"))) == ["a", "b", "c"]
    one = jsons.fingerprint(s("u"), s(1.5), s(22.0), s(" A  b"), s(None))
    assert of(one) == of(jsons.fingerprint(s("u"), s(1.5), s(22.0), s("a b"), s(""))) != of(jsons.fingerprint(s("u"), s(1.5), s(22.0), s("a b"), s("sku")))
    stamp = lambda x: s(x).cast("timestamp")
    assert str(of(jsons.cycle_start(stamp("2024-01-05"), 12))) == "2023-12-12 00:00:00" and of(jsons.cycle_days(stamp("2024-02-20"), 12)) == 29
