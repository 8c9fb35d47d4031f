"""Offers to listings, renewal, folds over cells, rates from payloads."""

import datetime as dt
import json

from pyspark.sql import functions as F

from siderite.operators import listing
from siderite.sources import rates
from siderite.sources.schemas import LISTING, OFFER
from siderite.sources.tables import table

OFFICIAL = "code bigint, name string, display_name string, status string, type string"
RATES = "currency string, rate double, rate_date string"


def test_listings_from_offers(spark):
    at = dt.datetime(2026, 5, 1)
    offers = [
        ("s", "1", "https://s.example/1", "NVP 9895  slice 4 g", None, [], None, 100.0, "EUR", True, None, ["https://i/1.jpg", "https://i/2.jpg", "https://i/logo.png"], 0),
        ("s", None, "https://s.example/2", "Unknown rock L 5 SOLD", None, None, None, None, "XXX", True, None, None, 1),
        ("s", "3", None, "no url", None, None, None, 1.0, "EUR", True, None, None, 2), ("s", "4", "https://s.example/4", "  ", None, None, None, 1.0, "EUR", True, None, None, 3),
    ]
    df = spark.createDataFrame(offers, OFFER).withColumn("scraped_at", F.lit(at))
    official = spark.createDataFrame([(7, "Northern Vash Plateau 9895", "NVP 9895", "Official", "H5"), (8, "Unknown", "Unknown", "Doubtful", "L4")], OFFICIAL)
    out = listing.listings_from(df, official, spark.createDataFrame([("EUR", 1.1, "2026-05-01")], RATES), "p")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in LISTING]
    got = {r["url"]: r for r in out.collect()}
    assert set(got) == {"https://s.example/1", "https://s.example/2"}
    a, b = got["https://s.example/1"], got["https://s.example/2"]
    assert (a["price_usd"], a["price_per_g_usd"], a["price_per_g"], a["weight_g"]) == (110.0, 27.5, 25.0, 4.0)
    assert (a["canonical_name"], a["meteorite_type"], a["subtype"], a["confidence"], a["metbull_code"]) == ("Northern Vash Plateau 9895", "ordinary chondrite", "H5", "high", "7")
    assert a["image_urls"] == ["https://i/1.jpg", "https://i/2.jpg"] and len(a["id"]) == 16
    assert (b["price_usd"], b["fx_rate_date"], b["subtype"], b["available"], b["canonical_name_status"], b["confidence"]) == (None, None, "L5", False, "unknown", "low")


def test_renewal_is_idempotent(spark):
    rows = table(spark, "/root/testdata/sf0.001", "listings")
    known = spark.createDataFrame([("EUR", 1.1, "2026-05-01"), ("USD", 1.0, "2026-05-01")], RATES)
    once = listing.renewed(rows, known)
    twice = listing.renewed(once, known)
    assert once.count() == rows.count() and once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.where("currency NOT IN ('EUR', 'USD') AND price_usd IS NOT NULL").count() == 0


def test_folds(spark):
    cells = [("t", 0, "img", None), ("t", 1, "Stone A", "a.jpg"), ("t", 2, "5 g", None), ("t", 3, "$ 5", None), ("t", 4, "sold", None), ("t", 5, "Stone B", None), ("t", 6, "$ 6", None), ("t", 7, "rest", None)]
    df = spark.createDataFrame(cells, "k string, n int, text string, image string")
    out = listing.folded_items(df, ["k"], "n", "text", F.col("text").rlike(r"^\$|^sold"))
    assert sorted((r["item"], r["texts"], r["close"]) for r in out.collect()) == [(0, ["img", "Stone A", "5 g"], "$ 5"), (1, [], "sold"), (2, ["Stone B"], "$ 6")]
    assert [r["i"] for r in listing.last_seen(df, ["k"], "n", "image", "i").orderBy("n").collect()] == [None] + ["a.jpg"] * 7


def test_rates_from_payloads(spark):
    bodies = [
        {"rates": {"EUR": 0.5, "CAD": 2.0, "XXX": -1}, "time_last_update_unix": 1777593600}, {"base": "EUR", "date": "2026-05-01", "rates": {"USD": 2.0, "CAD": 4.0}}, {"rates_to_usd": {"USD": 1.0, "EUR": 1.5, "CAD": 0.5}, "date": "2026-04-30"},
        {"rates": {"EUR": 0.5}, "date": "2026-05-01"}, {"rates": {"EUR": 0.5, "CAD": 2.0}}, {"rates": {"EUR": 0.5, "CAD": 2.0}, "time_last_update_utc": "Fri, 01 May 2026 00:00:01 +0000"},
    ]
    rows = [(i, "s", json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "s", "nope"), (10, "s", None)]
    got: dict = {}
    for r in rates.rates_from_payloads(spark.createDataFrame(rows, "seq int, source string, body string")).collect():
        got.setdefault((r["seq"], r["rate_date"]), {})[r["currency"]] = r["rate"]
    assert got == {(0, "2026-05-01"): {"USD": 1.0, "EUR": 2.0, "CAD": 0.5}, (1, "2026-05-01"): {"EUR": 2.0, "USD": 1.0, "CAD": 0.5}, (2, "2026-04-30"): {"USD": 1.0, "EUR": 1.5, "CAD": 0.5}, (5, "2026-05-01"): {"USD": 1.0, "EUR": 2.0, "CAD": 0.5}}
    saved = rates.rates_from_listings(table(spark, "/root/testdata/sf0.001", "listings"))
    assert saved.groupBy("currency").count().where("count > 1").count() == 0 and rates.dollars_only(spark).count() == 1
