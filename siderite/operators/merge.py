"""Keyed merges: first and last wins, the inventory merge, run selection, the bounded frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siderite.session import stored

HIGH_RATIO = 1e9


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of lowest ``seq`` for each key; null keys are a key. An aggregate, so a hot key combines map-side."""
    return _wins(df, keys, F.min(F.struct(seq, *[c for c in df.columns if c != seq and c not in keys])))


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of highest ``seq`` for each key."""
    return _wins(df, keys, F.max(F.struct(seq, *[c for c in df.columns if c != seq and c not in keys])))


def _wins(df: DataFrame, keys: list[str], best) -> DataFrame:
    return df.groupBy(*keys).agg(best.alias("_b")).select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def merge_inventory(old: DataFrame, fresh: DataFrame, scraped: DataFrame, enabled: DataFrame, preserve: bool = True) -> DataFrame:
    """The inventory after a run, with ``origin`` ``fresh`` or ``kept``.

    old, fresh: id, source and equal columns. scraped, enabled: source. A scraped source with new rows loses
    its old ones; a scraped one without keeps them; one that wasn't scraped keeps them if ``preserve``. Rows
    of sources that aren't enabled and rows without id vanish. Of an id in both, the fresh row holds.
    """
    refreshed = fresh.select("source").distinct()
    usable = old.where("id IS NOT NULL").join(enabled.select("source").distinct(), "source", "left_semi")
    kept = usable.join(refreshed.join(scraped, "source", "left_semi"), "source", "left_anti")
    if not preserve:
        kept = kept.join(scraped.select("source").distinct(), "source", "left_semi")
    new = fresh.where("id IS NOT NULL")
    kept = kept.join(new.select("id"), "id", "left_anti")
    return new.withColumn("origin", F.lit("fresh")).unionByName(kept.select(*new.columns).withColumn("origin", F.lit("kept")))


def empty_refreshes(fresh: DataFrame, scraped: DataFrame) -> DataFrame:
    """Scraped sources that gave no row."""
    return scraped.select("source").distinct().join(fresh.select("source").distinct(), "source", "left_anti")


def rotation_index(key: str, count: int) -> int:
    """Which of ``count`` sources a run takes: a whole number n takes n - 1 (0 and below count from the end), text its sha1."""
    import hashlib

    try:
        seed = int(key)
    except ValueError:
        seed = int(hashlib.sha1(key.encode()).hexdigest(), 16)
    return (seed - 1 if seed > 0 else seed) % count


def in_display_order(listings: DataFrame) -> DataFrame:
    """Listings by type, subtype, ratio and title; a missing type sorts as ``unknown``, ratio as very high."""
    return listings.orderBy(F.coalesce("meteorite_type", F.lit("unknown")), F.coalesce("subtype", F.lit("")), F.coalesce("price_per_g_usd", F.lit(HIGH_RATIO)), "title", "id")


def reachable(start: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """(url, depth): pages within ``rounds`` links of the start, each at its least depth.

    start: url; links: src, dst. One join for each round against the newest pages only, stored in between.
    """
    seen = stored(start.select("url").where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("url").alias("src"))
        found = links.join(front, "src").select(F.col("dst").alias("url")).where("url IS NOT NULL").distinct().join(seen, "url", "left_anti")
        found = stored(found.withColumn("depth", F.lit(depth)))
        if not found.limit(1).count():
            break
        seen = seen.unionByName(found)
    return seen


def refresh(old: DataFrame, offers: DataFrame, official: DataFrame, rates: DataFrame, registry: DataFrame, scraped: DataFrame, parser: str, preserve: bool = True) -> tuple[DataFrame, DataFrame]:
    """(inventory, violations) after a run: offers become listings, are merged with the old inventory, put in order and checked.

    old: rows of LISTING; offers: OFFER with scraped_at; registry: source, enabled; scraped: source. Violations are
    rows (id, rule, severity); the inventory is returned whatever they are, writing it is the caller's decision.
    """
    from siderite.operators import listing, quality

    fresh = listing.listings_from(offers, official, rates, parser)
    enabled = registry.where(F.coalesce("enabled", F.lit(True))).select("source")
    merged = merge_inventory(old, fresh, scraped, enabled, preserve)
    return in_display_order(merged), quality.violations(merged, quality.listing_rules(), ["id"])
