"""A key with a third of all rows: whole results, and a map-side combine before every exchange."""

from pyspark.sql import functions as F

from siderite.operators import explore, merge, skew, snapshots


def test_snapshots_with_a_hot_url(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("http://www.a.example/hot/")).otherwise(F.concat(F.lit("https://a.example/"), F.col("id")))
    rows = spark.range(12_000).select((F.col("id") % 2 + 1).cast("int").alias("snapshot_id"), hot.alias("url"), F.col("id").cast("double").alias("price"), F.lit(True).alias("available"), F.timestamp_seconds(F.col("id")).alias("scraped_at"))
    out = snapshots.snapshot_changes(rows)
    assert {(r["change"], r["count"]) for r in out.groupBy("change").count().collect()} == {("added", 4_000), ("removed", 4_000), ("changed", 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_aggregates_of_a_hot_key_combine_before_they_move(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("source"), F.col("id").cast("double").alias("price_usd"), F.timestamp_seconds("id").alias("scraped_at"), F.col("id").alias("seq"))
    stats = skew.eager_key_stats(rows, rows, ["source"], "price_usd", "scraped_at")
    assert {r["key_value"]: r["pairs"] for r in stats.where("l_rows > 1").collect()} == {"hot": 9_000_000}
    assert merge.last_wins(rows, ["source"], "seq").where("source = 'hot'").first()["seq"] == 8_997
    assert merge.first_wins(rows, ["source"], "seq").count() == 6_001
    buckets = explore.histogram(rows.withColumn("source", F.lit("one")), "source", "price_usd").collect()
    assert len(buckets) == 8 and sum(b["n"] for b in buckets) == 9_000


def test_scans_read_what_they_need(spark):
    from siderite.plans import catalogue

    plan = catalogue.queries()["search_substring"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "image_urls" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = catalogue.queries()["histogram_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(price_usd" in plan and "Python" not in plan
