"""Interactive queries over listings: search, filters, facets, summaries, distributions, order.

Every function takes and returns a DataFrame and names its columns by argument; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Display order of the type families; others come after them, then missing ones.
FAMILY_ORDER = ["lunar", "martian", "pallasite", "mesosiderite", "iron", "carbonaceous chondrite", "enstatite chondrite", "ordinary chondrite", "chondrite", "achondrite", "unknown"]
GROUP_CAP, MOST_BUCKETS, LEAST_BUCKETS = 24, 8, 2
UNSPECIFIED = "__unspecified__"


@dataclass(frozen=True)
class Selection:
    """What a reader has chosen; None leaves a condition out."""

    search: str | None = None
    category: str | None = None
    subtype: str | None = None
    source: str | None = None
    include_unavailable: bool = False


def category_key(category: Column) -> Column:
    """Lower case without outer blanks; missing and ``stone`` are ``unknown``."""
    key = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(key.isin("", "stone"), "unknown").otherwise(key)


def usd_value(usd: Column, native: Column, currency: Column) -> Column:
    """The dollar value, else the native one if it is in dollars or names no currency."""
    return F.coalesce(usd, F.when(F.coalesce(F.nullif(F.trim(currency), F.lit("")), F.lit("USD")) == "USD", native))


def searchable(*columns: str) -> Column:
    """One lower-case text of several columns; a missing one leaves its place empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def visible(listings: DataFrame, include_unavailable: bool = False) -> DataFrame:
    """Only ``available`` = false hides a row; null counts as available."""
    return listings if include_unavailable else listings.where(~F.col("available").eqNullSafe(F.lit(False)))


def select_rows(listings: DataFrame, chosen: Selection, text: list[str], category: str = "meteorite_type", subtype: str = "subtype", source: str = "source") -> DataFrame:
    """Rows that meet every condition that is set; the search is for a plain substring of the text columns."""
    rows = visible(listings, chosen.include_unavailable)
    if chosen.search:
        rows = rows.where(F.contains(searchable(*text), F.lit(chosen.search.strip().lower())))
    if chosen.category:
        rows = rows.where(category_key(F.col(category)) == chosen.category)
    if chosen.subtype:
        rows = rows.where(F.coalesce(F.col(subtype), F.lit(UNSPECIFIED)) == chosen.subtype)
    if chosen.source:
        rows = rows.where(F.col(source) == chosen.source)
    return rows


def facet_counts(rows: DataFrame, category: str = "meteorite_type", subtype: str = "subtype") -> DataFrame:
    """(category, subtype, level, n): counts by category and subtype, by category, and of all, in one pass."""
    keyed = rows.select(category_key(F.col(category)).alias("category"), F.coalesce(F.col(subtype), F.lit(UNSPECIFIED)).alias("subtype"))
    return keyed.rollup("category", "subtype").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def facet_counts_for(rows: DataFrame, choices: list[str], category: str = "meteorite_type") -> DataFrame:
    """(category, n) for the given choices, 0 where no row has one."""
    wanted = rows.sparkSession.createDataFrame([(c,) for c in choices], "category string")
    counts = rows.groupBy(category_key(F.col(category)).alias("category")).agg(F.count(F.lit(1)).alias("found"))
    return wanted.join(counts, "category", "left").select("category", F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


def ratio_summary(rows: DataFrame, value: Column, title: str = "title", scoped: bool = False) -> DataFrame:
    """(n, titles, mean, least): mean and least only where a filter is set or one title is left.

    Values that are missing or not finite don't count.
    """
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)
    measured = rows.select(finite.alias("v"), F.nullif(F.trim(F.col(title)), F.lit("")).alias("t"))
    agg = measured.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("titles"), F.avg("v").alias("m"), F.min("v").alias("l"))
    shown = F.lit(scoped) | (F.col("titles") == 1)
    return agg.select("n", "titles", F.when(shown, F.col("m")).alias("mean"), F.when(shown, F.col("l")).alias("least"))


def group_stats(rows: DataFrame, group: str, value: str, source: str = "source") -> DataFrame:
    """(group, n, sources, least, middle, mean, most) over the values that aren't null; the median is exact."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("sources"), F.min(value).alias("least"),
        F.median(value).alias("middle"), F.avg(value).alias("mean"), F.max(value).alias("most"),
    )


def capped_groups(stats: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """stats if there are at most ``cap`` groups, else no row; the count is one small aggregate."""
    few = stats.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap).select(F.lit(1).alias("_one"))
    return stats.withColumn("_one", F.lit(1)).join(few, "_one", "left_semi").drop("_one")


def histogram(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, bucket, low, high, n): equi-width buckets of each group, empty ones too.

    min(8, max(2, n)) buckets, one if all values are equal; the largest value is in the last. The range of a
    group is an aggregate joined back, so values of a hot group stay spread.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("v"))
    ranges = known.groupBy("group").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    buckets = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(LEAST_BUCKETS), F.col("total")))).cast("int")
    ranges = ranges.withColumn("buckets", buckets)
    at = F.when(F.col("buckets") == 1, 0).otherwise(F.least(F.col("buckets") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("buckets")))).cast("int")
    counted = known.join(ranges, "group").groupBy("group", at.alias("bucket")).agg(F.count(F.lit(1)).alias("found"))
    frame = ranges.select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    width = (F.col("hi") - F.col("lo")) / F.col("buckets")
    low, high = F.col("lo") + width * F.col("bucket"), F.when(F.col("bucket") == F.col("buckets") - 1, F.col("hi")).otherwise(F.col("lo") + width * (F.col("bucket") + 1))
    return frame.join(counted, ["group", "bucket"], "left").select("group", "bucket", low.alias("low"), high.alias("high"), F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


def in_bucket(value: Column, low: float, high: float, last: bool) -> Column:
    """low <= value < high; the last bucket holds its upper edge, too."""
    return (value >= low) & ((value <= high) if last else (value < high))


def natural_key(text: Column, digits: int = 12) -> Column:
    """A key by which ``nwa 2`` sorts before ``NWA 10``: lower case, each number padded with zeros."""
    lower = F.lower(text)
    padded = F.regexp_replace(lower, r"([0-9]+)", "0" * digits + "$1")
    return F.regexp_replace(padded, r"0+([0-9]{%d})(?![0-9])" % digits, "$1")


def top_rows(rows: DataFrame, key: Column, limit: int, descending: bool = False, ties: tuple[str, ...] = ("title", "id")) -> DataFrame:
    """The first ``limit`` rows with their place, missing keys last in both directions, ties by the given columns."""
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    order = [first, *[F.col(t).asc_nulls_last() for t in ties]]
    # the sort and limit run as one top-k per task; only ``limit`` rows reach the window
    best = rows.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("int"))


def family_rank(family: Column) -> Column:
    """Place of a family in the fixed order, 99 for others."""
    place = F.array_position(F.array(*[F.lit(f) for f in FAMILY_ORDER]), category_key(family))
    return F.when(place > 0, place).otherwise(99).cast("int")


def stage_counts(sources: DataFrame) -> DataFrame:
    """(stage, sources, enabled): a missing ``enabled`` counts as true."""
    return sources.groupBy("stage").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"))


#: Stages of disabled sources; others count as backlog.
STAGES = {"disabled_policy_blocked": "policyBlocked", "disabled_backlog": "backlog", "disabled_parser_start": "parserStart"}


def source_stage(stage: Column, enabled: Column) -> Column:
    """The group a source is shown in: ``enabled``, or what its stage says of a disabled one."""
    known = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])[stage]
    return F.when(F.coalesce(enabled, F.lit(True)), "enabled").otherwise(F.coalesce(known, F.lit("backlog")))


def sorted_sources(sources: DataFrame) -> DataFrame:
    """Sources with their group and place by natural order of the name; the registry is small, so one task orders it."""
    rows = sources.select("name", source_stage(F.col("stage"), F.col("enabled")).alias("stage_group"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.coalesce("name", F.lit(""))), "name")).cast("int"))
