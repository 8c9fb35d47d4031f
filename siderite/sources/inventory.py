"""The inventory as one JSON document, the registry, and the list of official names as CSV: read, built, written."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderite.functions.text import selector_key
from siderite.operators.enrich import name_key
from siderite.sources.schemas import INVENTORY, LISTING, REGISTRY


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(listings, run): rows of the document and its one row of metadata; a broken document is an empty inventory."""
    whole = spark.read.schema(INVENTORY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    listings = whole.select(F.explode("listings").alias("x")).select("x.*")
    return listings, whole.where("generated_at IS NOT NULL").drop("listings")


def write_inventory(listings: DataFrame, run: DataFrame, path: str) -> None:
    """The inventory as Parquet beside its run's JSON, as a new version below ``path``; ``current`` names the one that holds.

    A version is written whole before ``current`` is replaced by one rename, so a crash leaves the old inventory and
    readers see the old one or the new; versions but the last two are removed. A single document would pass
    through one task, so rows are written by all of them. See :func:`current_inventory`.
    """
    spark = listings.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    listings.write.parquet(f"{path}/{version}/listings")
    counted = run.withColumn("listing_count", F.lit(spark.read.parquet(f"{path}/{version}/listings").count()))
    counted.coalesce(1).write.json(f"{path}/{version}/run")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    before = _current(spark, path)
    named, target = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    out = fs.create(named, True)
    out.write(bytearray(version.encode()))
    out.close()
    # FileContext's rename replaces the target in one step
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(named, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0) if not fs.exists(target) else _overwrite(spark))
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _overwrite(spark: SparkSession):
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    return options


def _current(spark: SparkSession, path: str) -> str | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(f"{path}/current").first()["value"]


def current_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(listings, run) of the version that holds; None before the first."""
    version = _current(spark, path)
    return version and (spark.read.parquet(f"{path}/{version}/listings"), spark.read.json(f"{path}/{version}/run"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows, with repeats; one signed count decides it."""
    columns = a.columns
    signed = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    return signed.groupBy(*columns).agg(F.sum("_s").alias("n")).where("n <> 0").limit(1).count() == 0


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry's rows; a missing ``enabled`` is true, caps are clamped to 0 .. 1000."""
    rows = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    caps = {c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(1000)) for c in ("max_detail_pages", "max_api_pages", "max_products", "max_index_pages", "limit", "max_pages")}
    return rows.withColumns(caps | {"enabled": F.coalesce("enabled", F.lit(True))})


def choose_sources(registry: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, missing): registry rows named by name or parser, and the tokens that name none.

    Names are compared by letters and digits only; of rows that share one the first by name is taken.
    """
    known = registry.select("name", F.explode(F.array_distinct(F.array(selector_key(F.col("name")), selector_key(F.col("parser"))))).alias("token"))
    first = known.groupBy("token").agg(F.min("name").alias("name"))
    tokens = wanted.select(selector_key(F.col("token")).alias("token"), F.col("token").alias("given")).where("token <> ''")
    return registry.join(tokens.join(first, "token").select("name").distinct(), "name", "left_semi"), tokens.join(first, "token", "left_anti").select("given").distinct()


CSV = "Name string, Abbrev string, Status string, Fall string, Year string, Place string, Type string, Mass string, MetBull string, Antarctic string, Lat string, Long string, Comment string, Code string"
REQUIRED = ("Name", "Code", "Status", "Type")


def read_official_csv(spark: SparkSession, path: str) -> DataFrame:
    """(seq, code, name, display_name, abbrev, status, ...) of the list as CSV; columns are found by their heading."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"the list lacks the columns {missing}")
    have = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    whole = lambda c: F.floor(have(c).try_cast("double"))
    rows = raw.where(F.trim("Name") != "").select(
        F.monotonically_increasing_id().alias("seq"), whole("Code").cast("bigint").alias("code"), have("Name").alias("name"), F.coalesce(have("Abbrev"), have("Name")).alias("display_name"), have("Abbrev").alias("abbrev"),
        have("Status").alias("status"), have("Fall").alias("fall"), whole("Year").cast("int").alias("year"), have("Place").alias("place"), have("Type").alias("type"), have("Mass").try_cast("double").alias("mass_g"),
        whole("MetBull").cast("int").alias("metbull"), have("Antarctic").alias("antarctic"), have("Lat").try_cast("double").alias("lat"), have("Long").try_cast("double").alias("lon"), have("Comment").alias("remark"),
    )
    return rows


def build_name_dimension(rows: DataFrame, least_names: int = 80_000, least_aliases: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(names, aliases): of equal keys the last name and the first alias hold; raises below the floors.

    names: name_key and the columns of :func:`read_official_csv`. aliases: alias_key, name_key.
    """
    def keys(names: pd.Series) -> pd.Series:
        return names.map(name_key)

    key = F.pandas_udf(keys, "string")
    keyed = rows.withColumn("name_key", key("name")).where("name_key <> ''")
    last = F.max(F.struct("seq", *[c for c in rows.columns if c != "seq"])).alias("x")
    names = keyed.groupBy("name_key").agg(last).select("name_key", "x.*")
    numbered = F.regexp_extract("name", r"^(.*\D) ?(\d+)$", 2)
    variants = F.array_compact(F.array("name", "abbrev", "display_name", F.concat("name", F.lit(" meteorite")), F.when(numbered != "", F.concat(F.regexp_replace("abbrev", r" ?\d+$", ""), numbered)), F.replace(F.col("name"), F.lit(" "), F.lit("-"))))
    spelled = keyed.select("seq", "name_key", F.explode(variants).alias("alias")).withColumn("alias_key", key("alias")).where("alias_key <> ''")
    aliases = spelled.groupBy("alias_key").agg(F.min(F.struct("seq", "name_key")).alias("x")).select("alias_key", "x.name_key")
    for what, frame, least in (("names", names, least_names), ("aliases", aliases, least_aliases)):
        if (n := frame.count()) < least:
            raise ValueError(f"{n} {what}; at least {least} were expected")
    return names, aliases


def empty_listings(spark: SparkSession) -> DataFrame:
    """A source that may not be read: no row of the full schema."""
    return spark.createDataFrame([], LISTING)
