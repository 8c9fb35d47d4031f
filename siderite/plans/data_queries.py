"""The queries of the general data problems: p1, p3, p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderite.operators import skew, snapshots, units
from siderite.session import stored
from siderite.sources.tables import table

KEYS = ["source", "canonical_name"]
HEAVY_SHARE = 0.05


def _common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.common_units(table(spark, sf_dir, "listings"), table(spark, sf_dir, "sources"), table(spark, sf_dir, "fx_rates"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.wrong_values(_common_units(spark, sf_dir))


def p1_common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _common_units(spark, sf_dir).select("id", "source", "mass_g", "mass_basis", "unit", "unit_confidence", "rule_g", "currency_code", "usd")


def p1_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with grams and dollars: the title's mass, else what the exact check settles."""
    return _common_units(spark, sf_dir).select("id", "source", F.col("rule_g").alias("grams"), "usd")


def p1_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings whose unit the forest isn't confident of, with its guess; none has a converted mass."""
    return _common_units(spark, sf_dir).where("mass_basis = 'review'").select("id", "source", "weight_g", "price", "unit", "unit_confidence", "note_unit")


def p1_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measure, value): what the forest is worth on labelled rows it hasn't seen, and what it decided."""
    parsed, model = units.parsed_and_fitted(table(spark, sf_dir, "listings"), table(spark, sf_dir, "sources"))
    counts = units.basis_counts(units.convert(parsed, model, table(spark, sf_dir, "fx_rates")))
    name = F.concat_ws("_", F.coalesce("mass_basis", F.lit("without_mass")), F.when(F.col("note_named"), "noted").otherwise("unnoted"))
    told = counts.select(F.explode(F.create_map(name, F.col("listings").cast("double"), F.concat(name, F.lit("_against_rule")), F.col("against_rule").cast("double"))).alias("measure", "value"))
    return model.measured().unionByName(told)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "listing_snapshots"), table(spark, sf_dir, "inventory_runs"))


def p3_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("urls"))


def p5_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "listings"), table(spark, sf_dir, "listing_snapshots")
    return skew.eager_key_stats(left, right, KEYS, "price_usd", "scraped_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled up from the joined states of both tables, those that p5_key_ranges shows."""
    return skew.heavy_keys(stored(p5_key_stats(spark, sf_dir)), "l_rows", HEAVY_SHARE)


def p5_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ranges and newest rows of every key of listings or listing_snapshots, the null key included."""
    shown = ["field", "key_value", "l_rows", "l_values", "l_min", "l_max", "l_newest", "r_rows", "r_values", "r_min", "r_max", "r_newest", "pairs"]
    return p5_key_stats(spark, sf_dir).select(shown)


QUERIES = {f.__name__: f for f in (p1_found, p1_common_units, p1_settled, p1_review, p1_model, p3_found, p3_change_counts, p5_found, p5_key_ranges)}
