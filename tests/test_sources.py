"""Pages, payloads, inventory documents, the registry, the CSV list and landed folders."""

import json

import pytest
from pyspark.sql import functions as F

from siderite.sources import html, inventory, payloads
from siderite.sources.landed import LandedPages

PAGE = """<html><head><title>Shop &amp; Co</title><meta property="og:title" content="Big stone"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"x","offers":[{"price":"5"}]}]}</script>
<script type="application/ld+json">{broken</script><style>p{}</style></head><body><h1> A  <b>stone</b></h1><p>Weight: 12 g<br>Price:</p><p>$ 30</p><p>Related products</p>
<a href="/a.html" rel=nofollow>first <i>link</i></a><a href="b.html">second<img src="i.jpg" width="24px" alt="pic"></a><table><tr><td>one<td>two<img src=t.jpg></tr><tr><td>three</td><td><table><tr><td>in</td></tr></table></td></tr></table>
<form><input name=__VIEWSTATE value=abc><input name=q></form><p>open <b>end"""


def test_page_parts(spark):
    pages = spark.createDataFrame([("u", PAGE), ("n", None), ("e", "")], "url string, body string")
    got = {r["url"]: r for r in html.page_title(html.parse_pages(pages)).collect()}
    r = got["u"]
    assert r["title"] == "Shop & Co" and r["h1"] == "A stone" and r["page_title"] == "A stone" and r["meta"] == {"og:title": "Big stone"}
    assert "Weight: 12 g" in r["lines"] and r["lines"][-1] == "open end" and not any("{" in x for x in r["lines"])
    assert [(x["href"], x["text"]) for x in r["links"]] == [("/a.html", "first link"), ("b.html", "second")]
    assert r["images"][0]["width"] == 24 and r["inputs"] == {"__VIEWSTATE": "abc", "q": ""}
    assert [(c["tab"], c["row"], c["col"], c["text"]) for c in sorted(r["cells"])] == [(0, 0, 0, "one"), (0, 0, 1, "two"), (0, 1, 0, "three"), (0, 1, 1, "in"), (1, 0, 0, "in")]
    assert got["n"]["lines"] == [] and got["e"]["page_title"] is None


def test_nodes_labels_tables_sitemaps(spark):
    pages = html.parse_pages(spark.createDataFrame([("u", PAGE)], "url string, body string"))
    nodes = html.json_nodes(pages, ["url"]).orderBy("place").collect()
    assert [n["kind"] for n in nodes] == [None, "Product", None] and json.loads(nodes[2]["node"]) == {"price": "5"}
    values = pages.select(html.labelled_value("lines", "weight").alias("w"), html.labelled_value("lines", "price").alias("p"), html.labelled_value("lines", "colour").alias("c")).first()
    assert tuple(values) == ("12 g", "$ 30", None)
    table = {(r["tab"], r["col"]): (r["texts"], r["image"]) for r in html.table_records(pages, ["url"]).collect()}
    assert table[0, 1] == (["two", "in"], "t.jpg")
    sitemap = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url><url><LOC>https://a/2</LOC></url><loc>https://a/1</loc></urlset>",)], "body string")
    assert sorted(r["url"] for r in html.sitemap_urls(sitemap).collect()) == ["https://a/1", "https://a/2"]


def test_payloads(spark):
    shop = {"products": [{"id": 1, "handle": "h", "title": "Stone", "product_type": "T", "tags": "a, b", "body_html": "<p>x &amp; y</p>", "variants": [{"id": 1, "title": "S", "available": False, "price": "9"}, {"id": 2, "title": "L", "available": True, "price": "12.50"}], "images": [{"src": "https://i/1"}]}, {"id": 2, "handle": "g", "title": "Plain", "tags": ["c"], "variants": []}]}
    rows = spark.createDataFrame([("s", json.dumps(shop)), ("s", "not json"), ("s", None)], "source string, body string")
    got = {r["item_id"]: r for r in payloads.shop_offers(rows, spark.createDataFrame([("s", "https://s.example/")], "source string, base_url string")).collect()}
    assert got["1"]["title"] == "Stone - L" and got["1"]["price"] == 12.5 and got["1"]["url"] == "https://s.example/products/h" and got["1"]["tags"] == ["a", "b"] and got["1"]["description"] == "x & y"
    assert got["2"]["available"] is False and got["2"]["tags"] == ["c"]
    store = [{"id": 7, "name": "N &amp; M", "permalink": "https://w/7", "categories": [{"name": "c"}], "prices": {"price": "12345", "currency_code": "EUR", "currency_minor_unit": 2}, "is_in_stock": True, "is_purchasable": True, "is_on_backorder": True, "description": "<p>1 g</p><p>2 g</p>", "images": []}]
    offers = payloads.store_offers(spark.createDataFrame([("w", json.dumps(store))], "source string, body string"))
    r = offers.first()
    assert (r["title"], r["price"], r["currency"], r["available"]) == ("N & M", 123.45, "EUR", False)
    catalogue = {"total_pages": 1, "rows": [{"id": "1", "url": "u", "title": "T", "keywords": "a,b", "price": "US$ 5.00", "thumbnail": "t", "photo_album": ["t", "p"]}, {"id": "1", "url": "u2", "title": "again"}, {"id": "2", "title": "U"}]}
    details = [{"id": "1", "content": "<b>c</b>", "issell": "1"}]
    frame = lambda x: spark.createDataFrame([("k", json.dumps(x))], "source string, body string")
    got = {r["item_id"]: r for r in payloads.catalogue_offers(frame(catalogue), frame(details)).collect()}
    assert got["1"]["url"] == "u" and not got["1"]["available"] and got["1"]["image_urls"] == ["t", "p"] and got["2"]["available"]
    market = {"itemSummaries": [{"itemId": "m", "title": "M", "price": {"value": "3.5", "currency": "GBP"}, "seller": {"username": "z"}, "itemWebUrl": "w"}]}
    found = payloads.market_offers(spark.createDataFrame([("e", json.dumps(market), 2), ("e", json.dumps(market), 1)], "source string, body string, seq int")).collect()
    assert len(found) == 1 and found[0]["price"] == 3.5 and found[0]["seller"] == "z"


def test_inventory_document(spark, tmp_path):
    doc = {"generated_at": "2026-05-01T00:00:00+00:00", "source_count": 1, "listings": [{"id": "a", "title": "t", "price": 5, "image_urls": ["x"]}, {"id": "b"}], "exchange_rates": {"base": "USD", "rates_to_usd": {"EUR": 1.1}}}
    (tmp_path / "in.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{broken")
    listings, run = inventory.read_inventory(spark, str(tmp_path / "in.json"))
    assert listings.count() == 2 and run.first()["exchange_rates"]["rates_to_usd"] == {"EUR": 1.1}
    empty, none = inventory.read_inventory(spark, str(tmp_path / "bad.json"))
    assert empty.count() == 0 and none.count() == 0
    for _ in range(2):
        inventory.write_inventory(listings, run, str(tmp_path / "out"))
    held, told = inventory.current_inventory(spark, str(tmp_path / "out"))
    assert held.count() == 2 and told.first()["listing_count"] == 2 and inventory.current_inventory(spark, str(tmp_path / "none")) is None
    inventory.write_inventory(listings.limit(1), run, str(tmp_path / "out"))
    assert inventory.current_inventory(spark, str(tmp_path / "out"))[0].count() == 1 and held.count() == 2  # the version before is still whole
    assert inventory.same_rows(listings.select("id"), listings.select("id")) and not inventory.same_rows(listings.select("id"), listings.select("id").limit(1))
    assert inventory.empty_listings(spark).count() == 0


def test_registry(spark, tmp_path):
    sites = [{"name": "A & B", "parser": "a_b", "stage": "active_verified", "limit": 5000}, {"name": "C", "parser": "c", "enabled": False, "limit": -1}]
    (tmp_path / "sites.json").write_text(json.dumps(sites))
    rows = inventory.read_registry(spark, str(tmp_path / "sites.json"))
    assert sorted((r["name"], r["enabled"], r["limit"]) for r in rows.collect()) == [("A & B", True, 1000), ("C", False, 0)]
    chosen, missing = inventory.choose_sources(rows, spark.createDataFrame([("a-b",), ("nope",), ("",)], "token string"))
    assert [r["name"] for r in chosen.collect()] == ["A & B"] and [r["given"] for r in missing.collect()] == ["nope"]


def test_official_names(spark, tmp_path):
    text = "Name,Code,Status,Type,Abbrev,Year,Mass\nLódz 1,10,Official,L5,,1950,12.5\nGreat Plain 009,11,Official,H4,GP 009,x,\nGreat Plain 009,12,Doubtful,H5,GP 009,,\nŁódź 1,13,Official,L6,,,\n,,,,,,\n"
    (tmp_path / "names.csv").write_text(text, encoding="utf-8")
    rows = inventory.read_official_csv(spark, str(tmp_path / "names.csv"))
    names, aliases = inventory.build_name_dimension(rows, 1, 1)
    assert {r["name_key"]: r["code"] for r in names.collect()} == {"lodz 1": 13, "great plain 009": 12}
    assert {r["alias_key"]: r["name_key"] for r in aliases.collect()}["gp009"] == "great plain 009"
    with pytest.raises(ValueError, match="at least"):
        inventory.build_name_dimension(rows)
    (tmp_path / "short.csv").write_text("Name,Code\nx,1\n")
    with pytest.raises(ValueError, match="lacks"):
        inventory.read_official_csv(spark, str(tmp_path / "short.csv"))


def test_landed_pages(spark, tmp_path):
    for host in ("a.example", "b.example"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "p.html").write_text("<h1>x</h1>")
    (tmp_path / "a.example" / "gone.html").write_text("late")
    (tmp_path / "a.example" / "gone.json").write_text(json.dumps({"url": "https://a.example/gone", "status": 404}))
    (tmp_path / "b.example" / "odd.html").write_text("x")
    (tmp_path / "b.example" / "odd.json").write_text("{")
    spark.dataSource.register(LandedPages)
    pages = spark.read.format("landed_pages").load(str(tmp_path))
    got = {r["url"]: r for r in pages.collect()}
    assert len(got) == 4 and got["https://a.example/gone"]["body"] is None and got["https://b.example/odd"]["error"]
    assert pages.where(F.col("host") == "b.example").count() == 2
    assert spark.read.format("landed_pages").option("hosts", "b.example").load(str(tmp_path)).count() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("landed_pages").load(str(tmp_path / "none")).count() == 0
