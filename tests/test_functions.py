"""Vectors for the text, number and classification functions."""

import pytest
from pyspark.sql import functions as F

from siderite.functions import numbers, taxonomy, text
from siderite.operators import explore


def check(spark, build, cases):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, x string").select("i", build(F.col("x")).alias("y")).collect()
    got = {list(cases)[r["i"]]: r["y"] for r in rows}
    for k, want in cases.items():
        assert got[k] == (pytest.approx(want) if isinstance(want, float) else want), (k, got[k], want)


@pytest.mark.parametrize(
    "build, cases",
    [
        (numbers.number, {"1,234.5": 1234.5, "1,234": 1234.0, "12,5": 12.5, ",5": 0.5, "1.234,5": 1.2345, "abc": None, "": None, None: None}),
        (lambda c: numbers.price_number(c, True), {"1.234,56": 1234.56, "12,5": 12.5, "7": 7.0}),
        (numbers.price_number, {"1.234,56": 1.23456, "12,5": 125.0, "x": None}),
        (numbers.inferred_price, {"1.500": 1500.0, "1,50": 1.5, "1.234,5": 1234.5, "1,234.5": 1234.5, "12": 12.0, ".": None, "": None}),
        (numbers.currency_of, {"$": "USD", "us$": "USD", "€": "EUR", "cad": "CAD", "": None, None: None}),
        (lambda c: numbers.minor_units(c, F.lit(2)), {"12345": 123.45}),
        (lambda c: F.get(numbers.prices_in(c), F.lit(0))["value"], {"was $1,200.50, now EUR 900": 1200.5, "none": None}),
        (lambda c: F.element_at(numbers.prices_in(c), -1)["currency"], {"was $1,200.50, now EUR 900": "EUR"}),
        (text.clean, {"  a   b , c ( d ) ": "a b, c (d)", "": ""}),
        (text.display_case, {"GREAT STONE": "Great Stone", "NWA": "NWA", "Great": "Great", None: None}),
        (text.host, {"HTTPS://A.Example:80/x": "a.example:80", "/x": ""}),
        (text.domain, {"https://www.a.example:80/x": "a.example", "u@b.example/c": "b.example"}),
        (text.parent_domain, {"a.b.example.org": "example.org", "example.org": "example.org"}),
        (text.name_from_url, {"https://a.example/shop/big-red_stone%20x/": "big red stone x", "https://a.example": ""}),
        (text.spaced, {"bigStone12g": "big Stone 12 g"}),
        (text.selector_key, {"The Big-Shop!": "thebigshop"}),
        (lambda c: text.slug("f", c), {"L5 / 6": "f-l5-6"}),
        (text.unavailable, {"sold": True, "Sold out": True, "on hold": True, "out_of_stock": True, "sold by X": False, "": False, None: False}),
        (lambda c: text.around(c, "[0-9]+ g", 4, 3), {"total known 5 kg and 12 g here": "and 12 g he", "none": None}),
        (taxonomy.canonical_subtype, {"L 5": "L5", "CM-2": "CM2", "H56": "H5-6", "C 2-ung": "C2-UNG", "EH3-4": "EH3/4", "EH3/EH4": "EH3/EH4", "H/L 3": "H/L3", "PAL MG": "PAL-MG", "Eucrite - mmict": "Eucrite-mmict", "foo bar": "FOO BAR", "Lunar (Norite)": "norite", "": None, None: None}),
        (taxonomy.precedence, {"IAB": 90, "EUCRITE-MMICT": 80, "L5/6": 70, "L5": 50, "EUCRITE": 30, "OCTAHEDRITE": 20, "": 0}),
        (taxonomy.family_of, {"L5": "ordinary chondrite", "CM2": "carbonaceous chondrite", "EH4": "chondrite", "IAB": "iron", "PMG": "pallasite", "SHERGOTTITE": "martian", "EUC": "achondrite", "Lunar (basalt)": "lunar", "zzz": None, None: None}),
        (lambda c: taxonomy.best_subtype(F.split(c, ",")), {"EUC,L 5,H4": "L5", "L5,IAB": "IAB", "H4,L5": "H4"}),
        (explore.natural_key, {"nwa 2": "nwa 000000000002", "NWA 10": "nwa 000000000010"}),
        (explore.category_key, {"Stone": "unknown", None: "unknown", " Iron ": "iron"}),
    ],
)
def test_vectors(spark, build, cases):
    check(spark, build, cases)


def test_urls_and_images(spark):
    rows = spark.createDataFrame([("https://a.example/x/", "y.html"), ("https://a.example/", "mailto:z"), ("https://a.example/", None), ("https://a.example/", "//b.example/i.jpg")], "b string, u string")
    assert [r["o"] for r in text.resolved(rows, "b", "u", "o").collect()] == ["https://a.example/x/y.html", None, None, "https://b.example/i.jpg"]
    got = spark.range(1).select(text.image_list(F.array(F.lit("https://a.example/1.jpg"), F.lit("https://a.example/logo.png"), F.lit(None), F.lit("https://a.example/1.jpg"), F.lit("data:x"))).alias("i")).first()["i"]
    assert got == ["https://a.example/1.jpg"]
    assert [r["c"] for r in spark.createDataFrame([("chondrite", "ordinary chondrite"), ("iron", "pallasite")], "a string, b string").select(taxonomy.compatible(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False]
