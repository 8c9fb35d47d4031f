"""Readers, run logs, candidate sources, merge laws, streams."""

import datetime as dt

from pyspark.sql import functions as F

from siderite.operators import enrich, merge, quality, runs
from siderite.streaming import upsert

LISTED = "id string, source string, price double"


def test_readers_union_with_last_wins(spark):
    readers = runs.Readers()
    readers.register("one")(lambda s, cfg: s.createDataFrame([("a", cfg["name"], 1.0), (None, cfg["name"], 9.0)], LISTED))
    readers.register("two")(lambda s, cfg: s.createDataFrame([("a", cfg["name"], 2.0), ("b", cfg["name"], 3.0)], LISTED))
    rows, rejects = readers.scan(spark, [{"name": "x", "parser": "one"}, {"name": "y", "parser": "two"}, {"name": "z", "parser": "three"}], spark.createDataFrame([], LISTED))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "y", 2.0), ("b", "y", 3.0)] and [tuple(r) for r in rejects.collect()] == [("z", "unknown_parser")]


def test_run_log(spark):
    fetches = spark.createDataFrame([("x", "u1", 200, "detail"), ("x", "u1", 200, "detail"), ("x", "u2", 500, "index"), ("y", "u3", None, "index")], "source string, url string, status int, kind string")
    rejects = spark.createDataFrame([("x", "sold"), ("x", "sold"), ("x", "lot"), ("z", "lot")], "source string, reason string")
    log = {r["source"]: tuple(r)[1:] for r in runs.run_log(fetches, rejects, spark.createDataFrame([("x",)], "source string")).collect()}
    assert log == {"x": (3, 1, 1, 1, 3), "y": (1, 1, 0, 0, 0), "z": (0, 0, 0, 0, 1)}
    assert sorted(tuple(r) for r in runs.top_reasons(rejects, 1).collect()) == [("x", "sold", 2, 1), ("z", "lot", 1, 1)]


def test_candidate_sources(spark):
    registry = spark.createDataFrame([("https://shop.known.example/", ["https://www.other.example/x"])], "base_url string, inventory_urls array<string>")
    known = runs.known_domains(registry)
    assert {r["domain"] for r in known.collect()} == {"shop.known.example", "known.example", "other.example"}
    found = [(1, "https://a.known.example/1"), (2, "https://m.blocked.example/"), (3, "https://new.example/a"), (4, "http://www.new.example/b"), (5, None), (6, "https://unblocked.example/")]
    out = runs.screened(spark.createDataFrame(found, "seq int, url string").where("url IS NOT NULL"), known, spark.createDataFrame([("blocked.example",)], "domain string"))
    assert {r["seq"]: r["reason"] for r in out.collect()} == {1: "known", 2: "blocked", 3: None, 4: "repeated", 6: None}
    pages = spark.createDataFrame([("lunar meteorite slice 5 g, $ 30, add to cart, NWA 1", True, "cards"), ("blog article", False, None), (None, None, None)], "t string, f boolean, s string")
    scored = runs.candidate_scores(pages, runs.shop_evidence(F.col("t"), F.col("f"), F.col("s"))).collect()
    assert [r["score"] for r in scored] == [100, 0, 0] and scored[0]["evidence"] == ["terms", "price", "mass", "shop", "class", "style"]


def test_merge_laws(spark):
    frame = lambda rows, schema=LISTED: spark.createDataFrame(rows, schema)
    names = lambda *x: spark.createDataFrame([(s,) for s in x], "source string")
    old = frame([("1", "full", 1.0), ("2", "full", 1.0), ("3", "empty", 1.0), ("4", "idle", 1.0), ("5", "off", 1.0), (None, "idle", 1.0), ("6", "idle", 1.0)])
    fresh = frame([("2", "full", 2.0), ("7", "full", 2.0), ("6", "full", 2.0), (None, "full", 2.0)])
    merged = lambda keep: sorted((r["id"], r["origin"], r["price"]) for r in merge.merge_inventory(old, fresh, names("full", "empty"), names("full", "empty", "idle"), keep).collect())
    assert merged(True) == [("2", "fresh", 2.0), ("3", "kept", 1.0), ("4", "kept", 1.0), ("6", "fresh", 2.0), ("7", "fresh", 2.0)]
    assert merged(False) == [("2", "fresh", 2.0), ("3", "kept", 1.0), ("6", "fresh", 2.0), ("7", "fresh", 2.0)]
    assert [r["source"] for r in merge.empty_refreshes(fresh, names("full", "empty")).collect()] == ["empty"]


def test_rotation():
    assert [merge.rotation_index(k, 29) for k in ("1", "29", "30", "0", "-1", "abc")] == [0, 28, 0, 0, 28, 6]


def test_frontier_lookup_keys(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", None)], "src string, dst string")
    reached = merge.reachable(spark.createDataFrame([("a",), (None,)], "url string"), links, 3)
    assert {r["url"]: r["depth"] for r in reached.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    names = spark.createDataFrame([("NWA-869",), ("Tlacotepec Meteorite",), ("Łódź",), (None,)], "n string")
    assert {r["n"]: r["name_key"] for r in enrich.with_name_key(names, "n").collect()} == {"NWA-869": "nwa 869", "Tlacotepec Meteorite": "tlacotepec", "Łódź": "lodz", None: None}
    assert [r["reason"] for r in spark.range(3).select(runs.first_reason(("two", F.col("id") == 2), ("many", F.col("id") >= 1)).alias("reason")).collect()] == [None, "many", "two"]
    assert quality.set_algebra(names, names, "n").where("op LIKE '%except%'").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "k string, seq int, v double"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    parts = [[("a", 1, 1.0), ("b", 5, 1.0), ("a", 3, 3.0)], [("a", 2, 2.0), ("c", 1, 1.0)], [("b", 6, 9.0)]]
    for rows in parts:
        frame(rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert.upsert_stream(stream, table, ["k"], "seq", str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r) for r in upsert.read_table(spark, table, frame([]).schema).collect())
    assert got == [("a", 3, 3.0), ("b", 6, 9.0), ("c", 1, 1.0)]
    assert got == sorted(tuple(r) for r in merge.last_wins(spark.read.schema(schema).parquet(source), ["k"], "seq").collect())
    assert upsert.read_table(spark, str(tmp_path / "nowhere"), frame([]).schema).count() == 0


def test_windows_and_sessions(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 5, 1, 10, m)
    rows = [(t(0), "a", 1.0), (t(1), "a", 2.0), (t(20), "a", 4.0), (t(1), "b", 1.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string, value double").parquet(str(tmp_path / "e"))
    for name, df, want in (("w", upsert.windowed_counts(stream, "ts", "k", "10 minutes", "5 minutes"), 3), ("s", upsert.sessions(stream, "ts", "k", "5 minutes", "5 minutes"), 3)):
        q = df.writeStream.format("memory").queryName(f"out_{name}").outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        found = spark.table(f"out_{name}")
        assert found.count() == want if name == "w" else found.count() <= want
