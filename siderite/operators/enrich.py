"""Joins with small dimensions: exchange rates, official names, aliases; ordered lookups.

Dimensions are joined by equality and unhinted: below its threshold the optimizer broadcasts them, beyond it
sorts and merges.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Half-up on the binary value, alike in every engine; not the bank's rule."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def convert(listings: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds usd and usd_per_g: price at the rate of its keys; null without price or rate, the ratio without a mass."""
    joined = listings.join(rates, keys, "left")
    usd = rounded(F.col("price") * F.col("rate"), 2)
    return joined.withColumn("usd", usd).withColumn("usd_per_g", F.when(F.col("weight_g") > 0, rounded(F.col("usd") / F.col("weight_g"), 4))).drop("rate")


def first_known(*candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, level): for each key the value of the first relation that has one, level from 0."""
    leveled = [c.where(F.col(value).isNotNull()).select(key, value, F.lit(i).alias("level")) for i, c in enumerate(candidates)]
    every = leveled[0]
    for c in leveled[1:]:
        every = every.unionByName(c)
    best = F.min(F.struct("level", F.col(value).alias("v")))
    return every.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value), F.col("b.level").alias("level"))


def name_key(text: str | None) -> str | None:
    """The key of one name."""
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ł", "l")) if not unicodedata.combining(c))
    words = re.sub(r"[\s_\-]+", " ", re.sub(r"[\"'’‘“”`]", "", plain))
    return re.sub(r"\s+", " ", re.sub(r"\bmeteorites?\b", " ", words)).strip()


def with_name_key(df: DataFrame, text: str, out: str = "name_key") -> DataFrame:
    """Adds the key by which names are compared: no accents, case, quotes, hyphens or the word meteorite.

    No built-in decomposes accents, so it is an Arrow function, run once for each distinct text.
    """
    def run(values: pd.Series) -> pd.Series:
        return values.map(name_key)

    keys = df.select(text).distinct().select(text, F.pandas_udf(run, "string")(F.col(text)).alias(out))
    return df.join(keys.withColumnRenamed(text, "_text"), F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def first_match(candidates: DataFrame, row: str, place: str, key: str, entries: DataFrame) -> DataFrame:
    """(row, place, key, *entry columns): for each row the candidate of lowest place that an entry has.

    candidates: row, place, key; entries: unique ``key`` and more. Rows without a hit are left out.
    """
    others = [c for c in entries.columns if c != key]
    hits = candidates.join(entries, key)
    best = F.min(F.struct(place, key, *others)).alias("b")
    return hits.groupBy(row).agg(best).select(row, *[F.col(f"b.{c}").alias(c) for c in (place, key, *others)])


def name_lookup(names: DataFrame, aliases: DataFrame, official: DataFrame) -> DataFrame:
    """(name, code, how): names found as an official name, else as an alias of one entry only; none left out.

    Only entries with status Official count.
    """
    entries = official.where("status = 'Official'").select("code", "name")
    single = aliases.groupBy(F.col("alias").alias("name")).agg(F.count_distinct("code").alias("codes"), F.max("code").alias("code")).where("codes = 1").join(entries.select("code"), "code")
    direct = names.select("name").distinct().join(entries, "name").select("name", "code", F.lit(0).alias("place"))
    by_alias = names.select("name").distinct().join(single, "name").select("name", "code", F.lit(1).alias("place"))
    best = direct.unionByName(by_alias).groupBy("name").agg(F.min(F.struct("place", "code")).alias("b"))
    return best.select("name", F.col("b.code").alias("code"), F.when(F.col("b.place") == 0, "name").otherwise("alias").alias("how"))


def newest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: ``columns`` of the row with the highest ``order``, combined map-side."""
    best = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def carried(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Adds the last value that isn't null up to each row of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
