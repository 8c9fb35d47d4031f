"""The queries of the subpackage: p2, p4, p6, p7, p8, p9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderite.llm import mixing, names, packing, products, quantiles, tokens, truncation
from siderite.llm.sql import SQL
from siderite.session import stored
from siderite.sources.tables import table

KEYS = ["source", "canonical_name"]
PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95]
#: What each of the three steps (leaf, tree over the leaves, tree over the snapshots) may add to the rank error, as
#: a share of n, however many levels a tree has; and the bound that is checked.
RANK_SHARE = 0.002
RANK_BOUND = 3 * RANK_SHARE


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = table(spark, sf_dir, "listings").where("canonical_name_status = 'unknown'")
    return names.map_names(unknown, table(spark, sf_dir, "official_names"), table(spark, sf_dir, "name_aliases"))


def p2_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of the listings whose name is given, from their titles alone."""
    verified = table(spark, sf_dir, "listings").where("canonical_name_status = 'metbull_verified'")
    return names.map_names(verified, table(spark, sf_dir, "official_names"), table(spark, sf_dir, "name_aliases"))


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "listings"), table(spark, sf_dir, "official_names"), table(spark, sf_dir, "name_aliases")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.find_pairs(*_three(spark, sf_dir))


def p4_verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs among listings whose name is given."""
    listings, names_, aliases = _three(spark, sf_dir)
    return products.find_pairs(listings.where("canonical_name_status = 'metbull_verified'"), names_, aliases)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.group_pieces(*_three(spark, sf_dir))


def p4_verified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many listings of other sellers each listing whose name is given agrees, counted without pairs."""
    listings, names_, aliases = _three(spark, sf_dir)
    groups = products.group_pieces(listings.where("canonical_name_status = 'metbull_verified'"), names_, aliases)
    return groups.where("links > 0").select("id", "links")


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _snapshot_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "listing_snapshots").where("snapshot_id IS NOT NULL")
    parts = quantiles.summaries(rows, KEYS, "price_per_g_usd", ["snapshot_id"], RANK_SHARE)
    return quantiles.merge_summaries(parts, ["snapshot_id", "field", "key_value"], RANK_SHARE)


def _over_all(parts: DataFrame) -> DataFrame:
    return quantiles.merge_summaries(parts, ["field", "key_value"], RANK_SHARE, "snapshot_id")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each snapshot, and (snapshot_id null) of all, combined from the summaries of the single ones."""
    parts = stored(_snapshot_summaries(spark, sf_dir))
    single = quantiles.percentiles(parts, ["snapshot_id", "field", "key_value"], PROBABILITIES)
    combined = quantiles.percentiles(_over_all(parts), ["field", "key_value"], PROBABILITIES)
    return single.unionByName(combined.withColumn("snapshot_id", F.lit(None).cast("int")))


def p6_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentile's exact rank among all rows against the bound: (field, key_value, q, n, in_bound)."""
    found = quantiles.percentiles(_over_all(_snapshot_summaries(spark, sf_dir)), ["field", "key_value"], PROBABILITIES)
    rows = table(spark, sf_dir, "listing_snapshots").where("price_per_g_usd IS NOT NULL AND NOT isnan(price_per_g_usd) AND snapshot_id IS NOT NULL")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("key_value")) for k in KEYS])).alias("k"), "price_per_g_usd").select("k.*", "price_per_g_usd")
    # equal values are counted before the join, so a hot key meets its few percentiles with one row for each value
    counted = long.groupBy("field", "key_value", "price_per_g_usd").agg(F.count(F.lit(1)).alias("c"))
    beside = counted.join(found, ["field", "key_value"])
    below = F.sum(F.when(F.col("price_per_g_usd") < F.col("value"), F.col("c")).otherwise(0))
    upto = F.sum(F.when(F.col("price_per_g_usd") <= F.col("value"), F.col("c")).otherwise(0))
    ranks = beside.groupBy("field", "key_value", "q", "n", "rank").agg(below.alias("below"), upto.alias("upto"))
    off = F.greatest(F.col("below") + 1 - F.col("rank"), F.col("rank") - F.col("upto"), F.lit(0))
    return ranks.select("field", "key_value", "q", "n", (off <= F.ceil(F.lit(RANK_BOUND) * F.col("n"))).alias("in_bound"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_token_sizes(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of container the texts placed, and how often the packing breaks a rule."""
    sizes, kinds = _token_sizes(spark, sf_dir), table(spark, sf_dir, "container_sizes")
    return packing.placement_faults(packing.pack(sizes, kinds), sizes, kinds)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("kind").alias("topic"), F.md5("text").alias("text_key"), "text")
    return stored(tokens.token_counts(documents))


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).select("mix", "doc_id", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mix how often the selection breaks a rule."""
    sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.mix_faults(mixing.mix(sized, targets), targets, sized)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p9_cut_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(truncation.cut_documents(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_verified, p4_found, p4_groups, p4_verified_pairs, p4_verified_links, p6_percentiles, p6_rank_check, p7_containers, p7_fill, p7_checks, p8_selection, p8_shares, p8_checks, p9_found, p9_cut_shares)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
