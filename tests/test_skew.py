"""Eager aggregation against the join it replaces."""

import random

from pyspark.sql import functions as F

from siderite.operators import skew

SCHEMA = "source string, canonical_name string, price_usd double, scraped_at timestamp, field string"


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, float("nan"), 1.0, 2.5, 7.0]), None, "clash") for _ in range(n)]


def test_eager_join_equals_the_join(spark):
    left, right = spark.createDataFrame(rows(300, 1), SCHEMA), spark.createDataFrame(rows(200, 2), SCHEMA)
    got = {(r["field"], r["key_value"]): r for r in skew.eager_key_stats(left, right, ["source", "canonical_name"], "price_usd", "scraped_at").collect()}
    for k in ("source", "canonical_name"):
        joined = left.select(k, "price_usd").join(right.select(k), k)
        for r in joined.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.isnan("price_usd"), F.col("price_usd"))).alias("s")).collect():
            assert got[k, r[k]]["pairs"] == r["n"] and abs((got[k, r[k]]["pair_sum"] or 0) - (r["s"] or 0)) < 1e-6
        assert sum(r["l_rows"] for (f, _), r in got.items() if f == k) == 300
        assert got[k, None]["pairs"] == 0
    assert {r["key_value"] for r in skew.heavy_keys(skew.eager_key_stats(left, right, ["source", "canonical_name"], "price_usd", "scraped_at"), "l_rows", 0.4).where("field = 'source'").collect()} == {"hot"}
    empty = spark.createDataFrame([], SCHEMA)
    assert all(r["l_rows"] == 0 and r["pairs"] == 0 for r in skew.eager_key_stats(empty, right, ["source"], "price_usd", "scraped_at").collect())
    assert skew.eager_key_stats(empty, empty, ["source"], "price_usd", "scraped_at").count() == 0
    assert all(r["pairs"] == 0 for r in skew.eager_key_stats(left, empty, ["source"], "price_usd", "scraped_at").collect())


def test_keys_of_either_side_have_their_states(spark):
    left, right = [("a", 1.0), ("a", 3.0), (None, 2.0), ("l", 5.0)], [("a", 4.0), (None, 6.0), (None, 8.0), ("r", 7.0), ("r", None)]
    frame = lambda rows_: spark.createDataFrame([(k, None, v, None, "f") for k, v in rows_], SCHEMA)
    stats = lambda a, b: {r["key_value"]: r for r in skew.eager_key_stats(frame(a), frame(b), ["source"], "price_usd", "scraped_at").collect()}
    shown = lambda r: (r["l_rows"], r["l_values"], r["l_min"], r["l_max"], r["r_rows"], r["r_values"], r["r_min"], r["r_max"], r["pairs"], r["pair_sum"])
    assert {k: shown(r) for k, r in stats(left, right).items()} == {
        "a": (2, 2, 1.0, 3.0, 1, 1, 4.0, 4.0, 2, 4.0), None: (1, 1, 2.0, 2.0, 2, 2, 6.0, 8.0, 0, 0.0),
        "l": (1, 1, 5.0, 5.0, 0, 0, None, None, 0, 0.0), "r": (0, 0, None, None, 2, 1, 7.0, 7.0, 0, 0.0),
    }
    assert set(stats([], right)) == {"a", None, "r"} and set(stats(left, [])) == {"a", None, "l"}


def test_heavy_keys_come_from_the_join_of_both_tables(spark, monkeypatch):
    from siderite.plans import data_queries

    plans = []
    monkeypatch.setattr(data_queries, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    found = data_queries.p5_found(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "listings.parquet" in plans[0] and "listing_snapshots.parquet" in plans[0] and "FullOuter" in plans[0] and "partial_count" in plans[0]
