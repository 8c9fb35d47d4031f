"""Landed API payloads as offers: one schema for each kind of shop, one projection onto OFFER.

A payload is a row (source, body); a body that isn't JSON of its kind gives no offer. All JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.functions.numbers import minor_units
from siderite.functions.text import clean

SHOP = (
    "struct<products:array<struct<id:string,handle:string,title:string,product_type:string,tags:string,body_html:string,"
    "variants:array<struct<id:string,title:string,available:boolean,price:string>>,images:array<struct<src:string>>>>>"
)
STORE = (
    "array<struct<id:string,slug:string,name:string,permalink:string,categories:array<struct<name:string>>,tags:array<struct<name:string>>,description:string,short_description:string,"
    "prices:struct<price:string,currency_code:string,currency_minor_unit:int>,is_in_stock:boolean,is_purchasable:boolean,is_on_backorder:boolean,images:array<struct<src:string,thumbnail:string>>>>"
)
CATALOGUE = "struct<total_pages:int,rows:array<struct<id:string,url:string,title:string,keywords:string,specifications:string,price:string,thumbnail:string,photo_album:array<string>>>>"
DETAILS = "array<struct<id:string,content:string,issell:string>>"
MARKET = (
    "struct<itemSummaries:array<struct<itemId:string,title:string,shortDescription:string,categories:array<struct<categoryName:string>>,price:struct<value:string,currency:string>,"
    "buyingOptions:array<string>,seller:struct<username:string>,itemWebUrl:string,image:struct<imageUrl:string>,itemEndDate:string>>>"
)


def plain(html: Column) -> Column:
    """Text of a short HTML fragment."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>|</(?:p|div|li|tr)>", "\n"), r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _items(payloads: DataFrame, schema: str, path: str = "") -> DataFrame:
    body = F.from_json("body", schema)
    return payloads.select("source", F.posexplode(body if not path else body[path]).alias("place", "x"))


def shop_offers(payloads: DataFrame, base_urls: DataFrame) -> DataFrame:
    """Products with variants: the first variant that is available, else the first, is what is offered.

    Tags may be a list or a text with commas. base_urls: source, base_url.
    """
    rows = _items(payloads, SHOP, "products").join(base_urls, "source", "left")
    variant = F.coalesce(F.get(F.filter("x.variants", lambda v: v["available"]), F.lit(0)), F.get("x.variants", F.lit(0)))
    rows = rows.withColumn("v", variant)
    listed = F.from_json(F.col("x.tags"), "array<string>")
    tags = F.when(F.col("x.tags").startswith("["), listed).otherwise(F.transform(F.split("x.tags", ","), lambda t: F.trim(t)))
    own = F.when(~F.coalesce(F.lower(F.col("v.title")), F.lit("default title")).eqNullSafe("default title"), F.concat_ws(" - ", "x.title", "v.title")).otherwise(F.col("x.title"))
    return rows.select(
        "source", F.col("x.id").alias("item_id"), F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/products/"), F.col("x.handle")).alias("url"), clean(own).alias("title"), F.col("x.product_type").alias("category"),
        F.filter(tags, lambda t: t != "").alias("tags"), clean(plain(F.col("x.body_html"))).alias("description"), F.col("v.price").try_cast("double").alias("price"), F.lit("USD").alias("currency"),
        F.coalesce("v.available", F.lit(False)).alias("available"), F.lit(None).cast("string").alias("seller"), F.col("x.images.src").alias("image_urls"), "place",
    )


def store_offers(payloads: DataFrame) -> DataFrame:
    """Products of a store that quotes prices in the smallest coin; on backorder or not for sale isn't available."""
    ready = F.col("x.is_in_stock") & F.coalesce("x.is_purchasable", F.lit(True)) & ~F.coalesce("x.is_on_backorder", F.lit(False))
    return _items(payloads, STORE).select(
        "source", F.col("x.id").alias("item_id"), F.col("x.permalink").alias("url"), clean(plain(F.col("x.name"))).alias("title"), F.get("x.categories.name", F.lit(0)).alias("category"), F.col("x.tags.name").alias("tags"),
        clean(plain(F.concat_ws("\n", "x.short_description", "x.description"))).alias("description"), minor_units(F.col("x.prices.price"), F.coalesce("x.prices.currency_minor_unit", F.lit(0))).alias("price"),
        F.coalesce("x.prices.currency_code", F.lit("USD")).alias("currency"), F.coalesce(ready, F.lit(False)).alias("available"), F.lit(None).cast("string").alias("seller"), F.col("x.images.src").alias("image_urls"), "place",
    )


def description_rows(offers: DataFrame) -> DataFrame:
    """One row for each line of the description, with ``line`` and ``line_place``: lists of pieces in one product."""
    return offers.select("*", F.posexplode(F.filter(F.split("description", "\n"), lambda x: F.trim(x) != "")).alias("line_place", "line"))


def catalogue_offers(pages: DataFrame, details: DataFrame) -> DataFrame:
    """Rows of a paged catalogue with their details, where there are any; of repeated rows the first page's."""
    rows = _items(pages, CATALOGUE, "rows").select("source", "place", "x.*")
    first = rows.groupBy("source", "id").agg(F.min_by(F.struct("url", "title", "keywords", "price", "thumbnail", "photo_album"), "place").alias("x"), F.min("place").alias("place"))
    told = _items(details, DETAILS).select("source", "x.id", "x.content", "x.issell").groupBy("source", "id").agg(F.max(F.struct("content", "issell")).alias("d"))
    joined = first.join(told, ["source", "id"], "left")
    return joined.select(
        "source", F.col("id").alias("item_id"), "x.url", clean(F.col("x.title")).alias("title"), F.lit(None).cast("string").alias("category"), F.split("x.keywords", r"\s*,\s*").alias("tags"),
        clean(plain(F.col("d.content"))).alias("description"), F.regexp_replace("x.price", "[^0-9.]", "").try_cast("double").alias("price"), F.lit("USD").alias("currency"),
        (F.coalesce("d.issell", F.lit("0")) != "1").alias("available"), F.lit(None).cast("string").alias("seller"), F.array_distinct(F.array_compact(F.concat(F.array("x.thumbnail"), F.coalesce("x.photo_album", F.array().cast("array<string>"))))).alias("image_urls"), "place",
    )


def market_offers(payloads: DataFrame) -> DataFrame:
    """Items of marketplace searches; an item that several searches find counts once, as first found.

    payloads: source, body, and ``seq``, the order of searches and pages.
    """
    body = F.from_json("body", MARKET)
    rows = payloads.select("source", "seq", F.posexplode(body["itemSummaries"]).alias("place", "x"))
    first = rows.groupBy("source", F.col("x.itemId").alias("item_id")).agg(F.min_by("x", F.struct("seq", "place")).alias("x"), F.min(F.struct("seq", "place"))["place"].alias("place"))
    return first.select(
        "source", "item_id", F.col("x.itemWebUrl").alias("url"), clean(F.col("x.title")).alias("title"), F.get("x.categories.categoryName", F.lit(0)).alias("category"), F.col("x.buyingOptions").alias("tags"),
        clean(F.col("x.shortDescription")).alias("description"), F.col("x.price.value").try_cast("double").alias("price"), F.col("x.price.currency").alias("currency"), F.lit(True).alias("available"),
        F.col("x.seller.username").alias("seller"), F.array_compact(F.array("x.image.imageUrl")).alias("image_urls"), "place",
    )
