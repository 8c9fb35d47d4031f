"""Declarative checks: rules are named conditions, violations are rows; a report is one pass over the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.functions import taxonomy, text
from siderite.functions.units import CURRENCY_WORDS
from siderite.operators.enrich import rounded


@dataclass(frozen=True)
class Rule:
    """A check of a row: ``broken`` is true where it fails; null counts as kept."""

    name: str
    broken: Column
    severity: str = "error"


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def listing_rules() -> list[Rule]:
    """The checks a row of the inventory must pass by itself."""
    c = F.col
    return [
        Rule("missing_key", c("id").isNull() | c("url").isNull() | c("source").isNull()),
        Rule("missing_title", F.coalesce(F.trim("title"), F.lit("")) == ""),
        Rule("bad_url", ~c("url").rlike(r"^https?://[^/\s]+")),
        Rule("bad_confidence", ~c("confidence").isin("low", "medium", "high")),
        Rule("bad_status", ~c("canonical_name_status").isin("metbull_verified", "unknown")),
        Rule("price_not_positive", c("price") <= 0),
        Rule("mass_not_positive", c("weight_g") <= 0),
        Rule("unpriced_with_usd", c("price").isNull() & c("price_usd").isNotNull()),
        Rule("ratio_mismatch", ~near(c("price_per_g"), c("price") / F.nullif(c("weight_g"), F.lit(0.0)), 0.01)),
        Rule("unverified_with_name", (c("canonical_name_status") == "unknown") & c("canonical_name").isNotNull()),
        Rule("verified_without_name", (c("canonical_name_status") == "metbull_verified") & c("canonical_name").isNull()),
        Rule("images_repeated", F.size("image_urls") != F.size(F.array_distinct("image_urls"))),
        Rule("first_image_differs", F.get("image_urls", F.lit(0)) != c("image_url")),
        Rule("sold_but_available", c("available") & F.lower("title").rlike(r"\b(sold|on hold|reserved)\b"), "warning"),
        Rule("verified_before_scraped", c("last_verified_at") < c("scraped_at"), "warning"),
        Rule("no_availability", c("available").isNull()),
        Rule("no_moment", c("scraped_at").isNull() | c("last_verified_at").isNull()),
        Rule("bad_currency", (c("price").isNotNull() | c("currency").isNotNull()) & ~F.coalesce(c("currency").isin(list(CURRENCY_WORDS)), F.lit(False))),
        Rule("priced_without_usd", c("price").isNotNull() & (c("price_usd").isNull() | c("fx_rate_to_usd").isNull() | ~F.coalesce(c("fx_rate_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)))),
        Rule("unpriced_with_rate", c("price").isNull() & (c("fx_rate_to_usd").isNotNull() | c("fx_rate_date").isNotNull() | c("price_per_g").isNotNull() | c("price_per_g_usd").isNotNull())),
        Rule("usd_rate_not_one", (c("currency") == "USD") & (F.abs(c("fx_rate_to_usd") - 1) > 1e-6)),
        Rule("usd_mismatch", F.abs(c("price_usd") - rounded(c("price") * c("fx_rate_to_usd"), 2)) > 0.0101),
        Rule("usd_ratio_mismatch", ~near(c("price_per_g_usd"), c("price_usd") / F.nullif(c("weight_g"), F.lit(0.0)), 0.01)),
        Rule("verified_not_official", (c("canonical_name_status") == "metbull_verified") & ~c("metbull_status").eqNullSafe(F.lit("Official"))),
        Rule("unclean_name", (F.trim("canonical_name") != c("canonical_name")) | c("canonical_name").rlike(r"(?i)[\r\n]|https?://") | (F.length("canonical_name") > 120)),
        Rule("images_without_first", (F.size("image_urls") > 0) & c("image_url").isNull()),
        Rule("decorative_image", c("image_url").isNotNull() & text.decorative(c("image_url"))),
        Rule("range_without_mark", taxonomy.compact(c("subtype")).rlike("^(H|L|LL)[3-7][3-7]$")),
        Rule("type_conflict", ~_holds(c("meteorite_type"), taxonomy.family_of(c("subtype")))),
        Rule("text_conflict", _conflicts(F.coalesce(taxonomy.family_of(c("subtype")), c("meteorite_type")), taxonomy.text_families(c("classification_text")))),
    ]


def _conflicts(family: Column, named: Column) -> Column:
    """Whether a text names a family that the row's, if it is known, contradicts."""
    both = F.transform(named, lambda f: F.struct(f.alias("f"), family.alias("own")))
    return F.exists(both, lambda x: (x["own"] != "unknown") & ~taxonomy.compatible(x["own"], x["f"]))


def _holds(kind: Column, family: Column) -> Column:
    """Whether a row's type may stand beside its subtype's family; null without a family."""
    allowed = F.create_map(F.lit("chondrite"), F.array(F.lit("ordinary chondrite"), F.lit("carbonaceous chondrite")), F.lit("achondrite"), F.array(F.lit("lunar"), F.lit("martian")))
    one = F.array(F.struct(kind.alias("k"), family.alias("f")))
    return F.get(F.transform(one, lambda x: F.when(x["f"].isNotNull(), F.coalesce((x["k"] == x["f"]) | F.array_contains(allowed[x["f"]], x["k"]), F.lit(False)))), F.lit(0))


def mass_rules() -> list[Rule]:
    """Checks of a row with title_mass_g, see :func:`siderite.functions.units.with_title_mass`."""
    stated, mass = F.col("title_mass_g"), F.col("weight_g")
    return [Rule("mass_missing", stated.isNotNull() & mass.isNull()), Rule("title_mass_mismatch", F.abs(stated - mass) > F.greatest(F.lit(0.001), 0.0001 * stated))]


def metadata_faults(runs: DataFrame, held: DataFrame, registry: DataFrame) -> DataFrame:
    """(run, fault, n) for each run and fault, 0 included: what a run says about itself against its rows and the registry.

    runs: run, source_count, scraped_sources; held: run, source (the rows); registry: source, enabled. Faults:
    ``count`` (source_count isn't the number of scraped sources), ``unknown`` and ``disabled`` scraped sources,
    ``silent`` (scraped sources without a row), ``unscraped`` (sources with rows that weren't scraped).
    """
    scraped = runs.select("run", F.explode("scraped_sources").alias("source")).distinct()
    found = held.select("run", "source").where("source IS NOT NULL").distinct()
    each = lambda rows, fault: rows.select("run", F.lit(fault).alias("fault"))
    faults = [
        each(runs.where(~F.col("source_count").eqNullSafe(F.size("scraped_sources"))), "count"),
        each(scraped.join(registry, "source", "left_anti"), "unknown"),
        each(scraped.join(registry.where("NOT coalesce(enabled, true)"), "source", "left_semi"), "disabled"),
        each(scraped.join(found, ["run", "source"], "left_anti"), "silent"),
        each(found.join(runs.select("run"), "run", "left_semi").join(scraped, ["run", "source"], "left_anti"), "unscraped"),
    ]
    every = faults[0]
    for f in faults[1:]:
        every = every.unionByName(f)
    frame = runs.select("run", F.explode(F.array(*[F.lit(f) for f in ("count", "unknown", "disabled", "silent", "unscraped")])).alias("fault"))
    counted = every.groupBy("run", "fault").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, ["run", "fault"], "left").select("run", "fault", F.coalesce("n", F.lit(0)).alias("n"))


def violations(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(<keys>, rule, severity): one row for each broken rule of each row, all rules in one pass."""
    failed = F.array_compact(F.array(*[F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return rows.select(*keys, F.explode(failed).alias("_v")).select(*keys, "_v.rule", "_v.severity")


def rule_counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, n): how often each rule is broken, 0 included; one aggregate row, then unpivoted."""
    one = rows.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(<keys>, n) of keys that come more than once; nulls are equal."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, known, distinct_values): values are counted as (field, value) pairs first, so that no row is copied to one task."""
    # one expanded row for each column, shrunk to its different values before it moves; NaN and -0.0 count as SQL has them
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.xxhash64(c).alias("a"), F.hash(c).alias("b"), F.col(c).isNotNull().alias("known")) for c in columns])).alias("x")).select("x.*")
    counted = pairs.groupBy("field", "a", "b", "known").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("field").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known"), F.count_if("known").alias("distinct_values"))


def set_algebra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(op, key): the values of ``except`` both ways, ``intersect`` and ``union`` of two relations; nulls are equal.

    One aggregate of both sides' different values tells in which side each value is.
    """
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side"))).groupBy(key).agg(F.bit_or("side").alias("sides"))
    ops = F.array(F.lit("union"), F.when(F.col("sides") == 1, "left_except_right").when(F.col("sides") == 2, "right_except_left").otherwise("intersect"))
    return both.select(F.explode(ops).alias("op"), key)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): values that only one of two relations has; nulls are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
