"""Offers to listings: the one projection that builds a row of the inventory, and rows built again.

All JVM-side: names, families and rates are joined by key, everything else is an expression of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderite.functions import taxonomy, text
from siderite.functions.units import with_title_mass
from siderite.operators.enrich import rounded
from siderite.sources.schemas import LISTING

def confidence(evidence: list[Column]) -> Column:
    """high for four facts that are known, medium for two or three, else low."""
    points = sum((F.coalesce(e, F.lit(False)).cast("int") for e in evidence), F.lit(0))
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def row_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of the parts; a missing part is empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def in_hundredths(value: Column) -> Column:
    """A number as text with two decimals, alike however it was written."""
    return F.format_string("%.2f", value)


def listings_from(offers: DataFrame, official: DataFrame, rates: DataFrame, parser: str) -> DataFrame:
    """Rows of LISTING for offers (OFFER, with scraped_at): masses, ratios, names, families, dollars, ids.

    official: name_key-free list (code, name, display_name, status, type); a title names an entry if it
    begins with its name or short name. rates: currency, rate, rate_date. Offers without url and title have no row.
    """
    rows = with_title_mass(offers.where("url IS NOT NULL AND trim(title) <> ''").withColumn("title", text.clean(F.col("title"))))
    entries = official.where("status = 'Official'").select("code", "name", "display_name", "type")
    spelled = entries.select("*", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("display_name")))).alias("spelling"))
    words = F.split(F.lower("title"), " ")
    heads = rows.select("url", "title", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("spelling"))
    named = heads.join(spelled, "spelling").groupBy("url", "title").agg(F.max(F.struct(F.length("spelling").alias("l"), "code", "name", "display_name", "type")).alias("n"))
    rows = rows.join(named, ["url", "title"], "left").join(rates, "currency", "left")
    rows = rows.withColumn("_subtype", F.coalesce(taxonomy.canonical_subtype(F.col("n.type")), taxonomy.best_subtype(taxonomy.subtype_tokens(F.col("title")))))
    rows = rows.withColumns({"_family": F.coalesce(taxonomy.family_of(F.col("_subtype")), F.lit("unknown")), "_usd": rounded(F.col("price") * F.col("rate"), 2), "_images": text.image_list(F.col("image_urls"))})
    mass, priced = F.col("title_mass_g"), F.col("price") > 0
    ratio = lambda value: F.when((mass > 0) & priced, rounded(value / mass, 4))
    built = {
        "id": row_id(F.col("source"), F.col("url"), F.coalesce("item_id", "title"), in_hundredths(mass), in_hundredths(F.col("price"))), "source_url": F.col("url"), "canonical_name": F.col("n.name"), "canonical_name_display": F.col("n.display_name"),
        "canonical_name_source": F.when(F.col("n").isNotNull(), "title"), "canonical_name_status": F.when(F.col("n").isNotNull(), "metbull_verified").otherwise("unknown"), "weight_g": rounded(mass, 4), "price_per_g": ratio(F.col("price")),
        "price_usd": F.col("_usd"), "price_per_g_usd": ratio(F.col("_usd")), "fx_rate_to_usd": F.when(F.col("_usd").isNotNull(), F.col("rate")), "fx_rate_date": F.when(F.col("_usd").isNotNull(), F.col("rate_date")),
        "meteorite_type": F.col("_family"), "subtype": F.col("_subtype"), "classification_text": F.nullif(F.concat_ws(", ", F.nullif(F.col("_family"), F.lit("unknown")), F.col("_subtype")), F.lit("")), "image_url": F.get("_images", F.lit(0)),
        "image_urls": F.when(F.size("_images") > 1, F.col("_images")), "confidence": confidence([F.col("item_id").isNotNull(), F.col("_family") != "unknown", priced, mass > 0]), "available": F.col("available") & ~text.unavailable(F.col("title")),
        "parser": F.lit(parser), "last_verified_at": F.col("scraped_at"), "metbull_code": F.col("n.code").cast("string"), "metbull_status": F.when(F.col("n").isNotNull(), "Official"), "metbull_type": F.col("n.type"),
        "item_end_date": F.lit(None).cast("string"), "buying_options": F.lit(None).cast("array<string>"),
    }
    return rows.select(*[(built[f.name] if f.name in built else F.col(f.name)).cast(f.dataType).alias(f.name) for f in LISTING])


def renewed(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """Ratios, dollars and classification of saved rows worked out again; doing it twice changes nothing more.

    rates: currency, rate, rate_date; a row without a rate has no dollar values.
    """
    usd = rounded(F.col("price") * F.col("rate"), 2)
    ratio = lambda value: F.when((F.col("weight_g") > 0) & (F.col("price") > 0), rounded(value / F.col("weight_g"), 4))
    subtype = taxonomy.canonical_subtype(F.coalesce("metbull_type", "subtype"))
    rows = listings.drop("price_usd", "fx_rate_to_usd", "fx_rate_date").join(rates, "currency", "left").withColumns({"price_usd": usd, "subtype": subtype})
    rows = rows.withColumns({"price_per_g": ratio(F.col("price")), "price_per_g_usd": ratio(F.col("price_usd")), "fx_rate_to_usd": F.when(F.col("price_usd").isNotNull(), F.col("rate")), "fx_rate_date": F.when(F.col("price_usd").isNotNull(), F.col("rate_date")), "meteorite_type": F.coalesce(taxonomy.family_of(F.col("subtype")), "meteorite_type")})
    return rows.select(*listings.columns)


def folded_items(cells: DataFrame, keys: list[str], order: str, cell: str, closes: Column) -> DataFrame:
    """(<keys>, item, texts, close): runs of cells that end with a closing cell, such as a price or ``sold``.

    A state machine without state: a cell belongs to the item whose number is how many closing cells came
    before it. Cells after the last close belong to none. Each run of keys is one column of one page.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = cells.withColumn("_close", F.coalesce(closes, F.lit(False)))
    numbered = marked.withColumn("item", F.sum(F.col("_close").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_close").cast("int"))
    held = F.sort_array(F.collect_list(F.when(~F.col("_close"), F.struct(order, F.col(cell).alias("text")))))
    items = numbered.groupBy(*keys, "item").agg(held.alias("h"), F.max(F.when(F.col("_close"), F.col(cell))).alias("close"))
    return items.where("close IS NOT NULL").select(*keys, F.col("item").cast("int").alias("item"), F.col("h.text").alias("texts"), "close")


def last_seen(cells: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the last ``value`` that isn't null up to each cell: an image or label that holds for those after it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn(out, F.last(value, ignorenulls=True).over(w))
