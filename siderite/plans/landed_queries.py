"""Queries over small landed fixtures: pages, payloads, rates, the list of names, the registry, and a whole refresh.

No table holds pages or payloads, so the inputs stand here; each query's twin states what must come out.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderite.operators import listing, merge, quality, runs
from siderite.sources import html, inventory, payloads, rates
from siderite.sources.schemas import LISTING, OFFER

PAGE = """<html><head><title>Quarry &amp; Sons</title><meta property="og:title" content="Slab"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Slab","offers":{"@type":"Offer","price":"5"}}]}</script>
<script>var hidden = 1</script></head><body><h1>Green  <b>slab</b></h1><p>Weight: 12 g<br>Price:</p><p>$ 30</p><a href="/one.html">one</a><a href="two.html"><img src="p.jpg" width="40" alt="slab"></a>
<table><tr><th>Name</th><th>Mass</th></tr><tr><td>A</td><td>3 g</td></tr></table><input name=token value=xyz></body></html>"""
SITEMAP = "<urlset><url><loc> https://q.example/1 </loc></url><url><loc>https://q.example/2</loc></url><url><loc>https://q.example/1</loc></url></urlset>"
SHOP = {"products": [{"id": 1, "handle": "slab", "title": "Slab", "product_type": "Rock", "tags": "a, b", "body_html": "<p>x &amp; y</p>", "variants": [{"id": 1, "title": "S", "available": False, "price": "9"}, {"id": 2, "title": "L", "available": True, "price": "12.50"}], "images": [{"src": "https://i.example/1"}]}, {"id": 2, "handle": "plain", "title": "Plain", "tags": ["c"], "variants": []}]}
STORE = [{"id": 7, "name": "N &amp; M", "permalink": "https://w.example/7", "categories": [{"name": "c"}], "prices": {"price": "12345", "currency_code": "EUR", "currency_minor_unit": 2}, "is_in_stock": True, "is_purchasable": True, "is_on_backorder": True, "description": "<p>1 g</p><p>2 g</p>", "images": []}]
CATALOGUE = {"total_pages": 1, "rows": [{"id": "1", "url": "https://k.example/1", "title": "T", "keywords": "a,b", "price": "US$ 5.00", "thumbnail": "t", "photo_album": ["t", "p"]}, {"id": "1", "url": "again", "title": "again"}, {"id": "2", "url": "https://k.example/2", "title": "U"}]}
DETAILS = [{"id": "1", "content": "<b>c</b>", "issell": "1"}]
MARKET = {"itemSummaries": [{"itemId": "m", "title": "M", "price": {"value": "3.5", "currency": "GBP"}, "seller": {"username": "z"}, "itemWebUrl": "https://e.example/m"}]}
RATES = [{"rates": {"EUR": 0.5, "CAD": 2.0, "XXX": -1}, "time_last_update_unix": 1777593600}, {"base": "EUR", "date": "2026-05-02", "rates": {"USD": 2.0, "CAD": 4.0}}, {"rates": {"EUR": 0.5}, "date": "2026-05-01"}, "nothing"]
NAMES = [(0, 10, "Łódka 1", None, "Official"), (1, 11, "Great Plain 009", "GP 009", "Official"), (2, 12, "Great Plain 009", "GP 009", "Doubtful"), (3, 13, "Lodka 1", None, "Official")]
CELLS = [("t", 0, "Stone A", "a.jpg"), ("t", 1, "5 g", None), ("t", 2, "$ 5", None), ("t", 3, "sold", None), ("t", 4, "Stone B", None), ("t", 5, "$ 6", None), ("t", 6, "rest", None)]


def _payloads(spark: SparkSession, source: str, *bodies) -> DataFrame:
    return spark.createDataFrame([(source, b if isinstance(b, str) else json.dumps(b), i) for i, b in enumerate(bodies)], "source string, body string, seq int")


def page_parts(spark, sf_dir):
    pages = html.page_title(html.parse_pages(spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "url string, body string")))
    return pages.select("url", "page_title", "title", F.size("lines").alias("lines"), F.size("links").alias("links"), F.get("images", F.lit(0))["width"].alias("width"), F.size("cells").alias("cells"), F.col("inputs")["token"].alias("token"), html.labelled_value("lines", "weight").alias("weight"), html.labelled_value("lines", "price").alias("price"))


def page_nodes(spark, sf_dir):
    pages = html.parse_pages(spark.createDataFrame([("a", PAGE)], "url string, body string"))
    return html.json_nodes(pages, ["url"]).select("place", "kind")


def page_tables(spark, sf_dir):
    pages = html.parse_pages(spark.createDataFrame([("a", PAGE)], "url string, body string"))
    return html.table_records(pages, ["url"]).select("col", F.array_join("texts", "|").alias("texts"))


def sitemap_urls(spark, sf_dir):
    return html.sitemap_urls(spark.createDataFrame([(SITEMAP,)], "body string"))


def _shown(offers: DataFrame) -> DataFrame:
    return offers.select("source", "item_id", "url", "title", "price", "currency", "available", "description", F.array_join("tags", "|").alias("tags"))


def shop_offers(spark, sf_dir):
    return _shown(payloads.shop_offers(_payloads(spark, "s", SHOP, "no json"), spark.createDataFrame([("s", "https://s.example/")], "source string, base_url string")))


def store_offers(spark, sf_dir):
    return _shown(payloads.store_offers(_payloads(spark, "w", STORE, "no json")))


def store_lines(spark, sf_dir):
    return payloads.description_rows(payloads.store_offers(_payloads(spark, "w", STORE)).withColumn("description", F.lit("1 g\n\n2 g"))).select("item_id", "line_place", "line")


def catalogue_offers(spark, sf_dir):
    return _shown(payloads.catalogue_offers(_payloads(spark, "k", CATALOGUE), _payloads(spark, "k", DETAILS)))


def market_offers(spark, sf_dir):
    return payloads.market_offers(_payloads(spark, "e", MARKET, MARKET)).select("item_id", "url", "title", "price", "currency", "seller")


def landed_rates(spark, sf_dir):
    return rates.rates_from_payloads(_payloads(spark, "fx", *RATES)).select("seq", "rate_date", "currency", "rate")


def name_dimension(spark, sf_dir):
    rows = spark.createDataFrame(NAMES, "seq bigint, code bigint, name string, abbrev string, status string").withColumn("display_name", F.coalesce("abbrev", "name"))
    names, aliases = inventory.build_name_dimension(rows, 1, 1)
    return names.select(F.lit("name").alias("kind"), F.col("name_key").alias("key"), F.col("code").cast("string").alias("value")).unionByName(aliases.select(F.lit("alias").alias("kind"), F.col("alias_key").alias("key"), F.col("name_key").alias("value")))


def folded_cells(spark, sf_dir):
    cells = spark.createDataFrame(CELLS, "page string, n int, text string, image string")
    seen = listing.last_seen(cells, ["page"], "n", "image", "shown")
    return listing.folded_items(seen, ["page"], "n", "text", F.col("text").rlike(r"^\$|^sold")).select("item", F.array_join("texts", "|").alias("texts"), "close")


def reachable_pages(spark, sf_dir):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "a"), ("x", "y")], "src string, dst string")
    return merge.reachable(spark.createDataFrame([("a",)], "url string"), links, 2)


def chosen_sources(spark, sf_dir):
    registry = spark.createDataFrame([("A & B", "a_b"), ("C", "c")], "name string, parser string")
    chosen, missing = inventory.choose_sources(registry, spark.createDataFrame([("a-b",), ("nope",), ("",)], "token string"))
    return chosen.select(F.lit("chosen").alias("kind"), "name").unionByName(missing.select(F.lit("missing").alias("kind"), F.col("given").alias("name")))


def reader_registry(spark, sf_dir):
    readers = runs.Readers()

    @readers.register("one")
    def one(session, source):
        return session.createDataFrame([("i1", source["name"]), ("i2", source["name"])], "id string, source string")

    rows, rejects = readers.scan(spark, [{"name": "P", "parser": "one"}, {"name": "Q", "parser": "one"}, {"name": "R", "parser": "none"}], spark.createDataFrame([], "id string, source string"))
    return rows.select(F.lit("row").alias("kind"), "id", "source").unionByName(rejects.select(F.lit("reject").alias("kind"), F.col("reason").alias("id"), "source"))


def run_summary(spark, sf_dir):
    fetches = spark.createDataFrame([("P", "u1", 200, "detail"), ("P", "u1", 200, "detail"), ("P", "u2", 404, "index"), ("Q", "u3", None, "index")], "source string, url string, status int, kind string")
    return runs.run_log(fetches, spark.createDataFrame([("P", "sold"), ("R", "sold")], "source string, reason string"), spark.createDataFrame([("P",), ("P",)], "source string"))


def discovery(spark, sf_dir):
    results = spark.createDataFrame([(1, "https://new.example/shop", "Iron slices", "12 g for $ 30"), (2, "https://www.new.example/x", "again", ""), (3, "https://known.example/", "", ""), (4, "https://a.blocked.example/", "", ""), (5, "https://blog.example/", "A guide to lunar rocks", "")], "seq int, url string, title string, snippet string")
    one = lambda d: spark.createDataFrame([(d,)], "domain string")
    pages = spark.createDataFrame([("https://new.example/shop", "<p>Our store of chondrite</p> cdn.shopify.com")], "url string, body string")
    return runs.discovery_report(results, one("known.example"), one("blocked.example"), pages).select("seq", "domain", "reason", "style", "score")


def discovery_faults(spark, sf_dir):
    report = spark.createDataFrame([(1, "a.example", None, 10), (2, "a.example", None, 200), (3, "known.example", None, 5), (4, "x.example", "known", None)], "seq int, domain string, reason string, score int")
    one = lambda d: spark.createDataFrame([(d,)], "domain string")
    return runs.report_faults(report, one("known.example"), one("blocked.example"))


def broken_rows(spark, sf_dir):
    """One row for each rule that breaks it and little else: every rule is seen to fire."""
    at = dt.datetime(2026, 5, 1)
    good = {"id": "good", "source": "S", "url": "https://s.example/1", "title": "Stone", "confidence": "high", "available": True, "scraped_at": at, "last_verified_at": at, "canonical_name_status": "unknown", "price": 10.0, "currency": "USD", "price_usd": 10.0, "fx_rate_to_usd": 1.0, "fx_rate_date": "2026-05-01", "weight_g": 5.0, "price_per_g": 2.0, "price_per_g_usd": 2.0, "meteorite_type": "iron", "subtype": "IAB", "classification_text": "iron, IAB", "image_url": "https://i.example/1.jpg", "image_urls": ["https://i.example/1.jpg"]}
    changes = {
        "missing_key": {"source": None}, "missing_title": {"title": " "}, "bad_url": {"url": "ftp:x"}, "bad_confidence": {"confidence": "sure"}, "bad_status": {"canonical_name_status": "maybe"}, "price_not_positive": {"price": 0.0, "price_usd": 0.0, "price_per_g": None, "price_per_g_usd": None},
        "mass_not_positive": {"weight_g": -5.0, "price_per_g": None, "price_per_g_usd": None}, "unpriced_with_usd": {"price": None, "fx_rate_to_usd": None, "fx_rate_date": None, "price_per_g": None, "price_per_g_usd": None, "currency": None}, "ratio_mismatch": {"price_per_g": 3.0}, "unverified_with_name": {"canonical_name": "X"},
        "verified_without_name": {"canonical_name_status": "metbull_verified", "metbull_status": "Official"}, "images_repeated": {"image_urls": ["https://i.example/1.jpg", "https://i.example/1.jpg"]}, "first_image_differs": {"image_urls": ["https://i.example/2.jpg"]}, "sold_but_available": {"title": "Stone sold"}, "verified_before_scraped": {"last_verified_at": at - dt.timedelta(days=1)},
        "no_availability": {"available": None}, "no_moment": {"scraped_at": None}, "bad_currency": {"currency": "shells"}, "priced_without_usd": {"fx_rate_date": "May"}, "unpriced_with_rate": {"price": None, "price_usd": None, "price_per_g": None, "price_per_g_usd": None}, "usd_rate_not_one": {"fx_rate_to_usd": 1.1, "price_usd": 11.0, "price_per_g_usd": 2.2},
        "usd_mismatch": {"price_usd": 10.5, "price_per_g_usd": 2.1}, "usd_ratio_mismatch": {"price_per_g_usd": 5.0}, "verified_not_official": {"canonical_name_status": "metbull_verified", "canonical_name": "X"}, "unclean_name": {"canonical_name_status": "metbull_verified", "metbull_status": "Official", "canonical_name": "X "},
        "images_without_first": {"image_url": None}, "decorative_image": {"image_url": "https://i.example/logo.png", "image_urls": None}, "range_without_mark": {"subtype": "H56", "meteorite_type": "ordinary chondrite", "classification_text": None}, "type_conflict": {"meteorite_type": "pallasite"}, "text_conflict": {"classification_text": "iron, L5"},
    }
    rows = [tuple((good | {"id": name} | change).get(f.name) for f in LISTING) for name, change in {"good": {}, **changes}.items()]
    rules = quality.listing_rules()
    found = quality.violations(spark.createDataFrame(rows, LISTING), rules, ["id"])
    # a row that breaks its own rule, or the good row any
    return found.where("id = rule OR id = 'good'").select(F.coalesce("id", F.lit("missing_key")).alias("id"), "rule", "severity")


def whole_refresh(spark, sf_dir):
    """Offers to listings, merged with an old inventory, put in order and checked."""
    at = dt.datetime(2026, 5, 2)
    offers = spark.createDataFrame([("S", "1", "https://s.example/1", "GP 9895 slice 4 g", None, [], None, 100.0, "EUR", True, None, ["https://i.example/1.jpg"], 0), ("S", "2", "https://s.example/2", "Rock L 5 SOLD", None, None, None, None, None, True, None, None, 1)], OFFER).withColumn("scraped_at", F.lit(at))
    old = spark.createDataFrame([tuple({"id": i, "source": s, "title": f"Old {i}", "url": f"https://s.example/{i}", "canonical_name_status": "unknown", "confidence": "low", "available": True, "scraped_at": at, "last_verified_at": at}.get(f.name) for f in LISTING) for i, s in (("o1", "S"), ("o2", "T"), ("o3", "U"), ("o4", "V"))], LISTING)
    official = spark.createDataFrame([(7, "Great Plain 9895", "GP 9895", "Official", "H5")], "code bigint, name string, display_name string, status string, type string")
    registry = spark.createDataFrame([("S", True), ("T", None), ("U", False), ("V", True)], "source string, enabled boolean")
    kept, broken = merge.refresh(old, offers, official, spark.createDataFrame([("EUR", 1.1, "2026-05-02")], "currency string, rate double, rate_date string"), registry, spark.createDataFrame([("S",), ("V",)], "source string"), "p")
    return kept.select("origin", "source", "title", "price_usd", "meteorite_type", "subtype", "available").unionByName(broken.select(F.lit("broken").alias("origin"), F.lit(None).cast("string").alias("source"), F.col("rule").alias("title"), F.lit(None).cast("double").alias("price_usd"), F.lit(None).cast("string").alias("meteorite_type"), F.col("severity").alias("subtype"), F.lit(None).cast("boolean").alias("available")))


QUERIES = {
    f.__name__: f
    for f in (
        page_parts, page_nodes, page_tables, sitemap_urls, shop_offers, store_offers, store_lines, catalogue_offers, market_offers, landed_rates, name_dimension, folded_cells,
        reachable_pages, chosen_sources, reader_registry, run_summary, discovery, discovery_faults, broken_rows, whole_refresh,
    )
}

_RULES = [
    "missing_key", "missing_title", "bad_url", "bad_confidence", "bad_status", "price_not_positive", "mass_not_positive", "unpriced_with_usd", "ratio_mismatch", "unverified_with_name", "verified_without_name", "images_repeated", "first_image_differs",
    "no_availability", "no_moment", "bad_currency", "priced_without_usd", "unpriced_with_rate", "usd_rate_not_one", "usd_mismatch", "usd_ratio_mismatch", "verified_not_official", "unclean_name", "images_without_first", "decorative_image", "range_without_mark", "type_conflict", "text_conflict",
]


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({columns})"


SQL = {
    "page_parts": _values("url, page_title, title, lines, links, width, cells, token, weight, price", "'a', 'Green slab', 'Quarry & Sons', 10, 2, 40, 4, 'xyz', '12 g', '$ 30'", "'b', NULL, NULL, 0, 0, NULL, 0, NULL, NULL, NULL", "'c', NULL, NULL, 0, 0, NULL, 0, NULL, NULL, NULL"),
    "page_nodes": _values("place, kind", "0, NULL", "1, 'Product'", "2, 'Offer'"),
    "page_tables": _values("col, texts", "0, 'Name|A'", "1, 'Mass|3 g'"),
    "sitemap_urls": _values("url, place", "'https://q.example/1', 0", "'https://q.example/2', 1"),
    "shop_offers": _values("source, item_id, url, title, price, currency, available, description, tags", "'s', '1', 'https://s.example/products/slab', 'Slab - L', 12.5::DOUBLE, 'USD', TRUE, 'x & y', 'a|b'", "'s', '2', 'https://s.example/products/plain', 'Plain', NULL, 'USD', FALSE, NULL, 'c'"),
    "store_offers": _values("source, item_id, url, title, price, currency, available, description, tags", "'w', '7', 'https://w.example/7', 'N & M', 123.45::DOUBLE, 'EUR', FALSE, '1 g 2 g', NULL::VARCHAR"),
    "store_lines": _values("item_id, line_place, line", "'7', 0, '1 g'", "'7', 1, '2 g'"),
    "catalogue_offers": _values("source, item_id, url, title, price, currency, available, description, tags", "'k', '1', 'https://k.example/1', 'T', 5::DOUBLE, 'USD', FALSE, 'c', 'a|b'", "'k', '2', 'https://k.example/2', 'U', NULL, 'USD', TRUE, NULL, NULL"),
    "market_offers": _values("item_id, url, title, price, currency, seller", "'m', 'https://e.example/m', 'M', 3.5::DOUBLE, 'GBP', 'z'"),
    "landed_rates": _values("seq, rate_date, currency, rate", "0, '2026-05-01', 'USD', 1::DOUBLE", "0, '2026-05-01', 'EUR', 2", "0, '2026-05-01', 'CAD', 0.5", "1, '2026-05-02', 'USD', 1", "1, '2026-05-02', 'EUR', 2", "1, '2026-05-02', 'CAD', 0.5"),
    "name_dimension": _values("kind, key, value", "'name', 'lodka 1', '13'", "'name', 'great plain 009', '12'", "'alias', 'lodka 1', 'lodka 1'", "'alias', 'great plain 009', 'great plain 009'", "'alias', 'gp 009', 'great plain 009'", "'alias', 'gp009', 'great plain 009'"),
    "folded_cells": _values("item, texts, close", "0, 'Stone A|5 g', '$ 5'", "1, '', 'sold'", "2, 'Stone B', '$ 6'"),
    "reachable_pages": _values("url, depth", "'a', 0", "'b', 1", "'c', 2"),
    "chosen_sources": _values("kind, name", "'chosen', 'A & B'", "'missing', 'nope'"),
    "reader_registry": _values("kind, id, source", "'row', 'i1', 'Q'", "'row', 'i2', 'Q'", "'reject', 'unknown_parser', 'R'"),
    "run_summary": _values("source, pages, failed, detail_urls, parsed, rejected", "'P', 3, 1, 1, 2, 1", "'Q', 1, 1, 0, 0, 0", "'R', 0, 0, 0, 0, 1"),
    "discovery": _values("seq, domain, reason, style, score", "1, 'new.example', NULL, 'shopify', 90", "2, 'new.example', 'repeated', NULL, NULL", "3, 'known.example', 'known', NULL, NULL", "4, 'a.blocked.example', 'blocked', NULL, NULL", "5, 'blog.example', NULL, 'unknown', 0"),
    "discovery_faults": _values("fault, n", "'known', 1", "'blocked', 0", "'repeated', 1", "'score', 1"),
    "broken_rows": _values("id, rule, severity", *[f"'{r}', '{r}', 'error'" for r in _RULES], *[f"'{r}', '{r}', 'warning'" for r in ("sold_but_available", "verified_before_scraped")]),
    "whole_refresh": _values("origin, source, title, price_usd, meteorite_type, subtype, available", "'fresh', 'S', 'GP 9895 slice 4 g', 110::DOUBLE, 'ordinary chondrite', 'H5', TRUE", "'fresh', 'S', 'Rock L 5 SOLD', NULL, 'ordinary chondrite', 'L5', FALSE", "'kept', 'T', 'Old o2', NULL, NULL, NULL, TRUE", "'kept', 'V', 'Old o4', NULL, NULL, NULL, TRUE"),
}
