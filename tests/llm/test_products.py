"""Pairs of listings of one piece against brute force on sf0.001, and the parts of titles they rest on."""

from itertools import combinations

from siderite.llm import products, titles
from siderite.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_sizes_and_collections(spark):
    cases = {
        "a 36 × 28 × 18.5 MM": ("18500x28000x36000", None), "1,36 x 3,72 x 1,02cm": ("10200x13600x37200", None), "27.2 by 23.6 by 3 mm": ("3000x23600x27200", None), "3 x 4 mm": (None, None),
        "ex Okonvar coll. #1405": (None, "okonvar|1405"), "TOLLIVER HOUSE No 1329": (None, "tolliver house|1329"), "(Bramhollow 1463)": (None, "bramhollow|1463"), "Slg. Okonvar Nr. 2269": (None, "okonvar|2269"),
        "slice Grauwinkel Collection no. 1058": (None, "grauwinkel|1058"), "coll. Ashdown Cabinet 4156": (None, "ashdown cabinet|4156"), "NVP No. 9895": (None, None), "": (None, None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "title string")
    got = titles.with_collection_number(titles.with_sizes(rows, "title"), "title").collect()
    assert {r["title"]: (r["size_key"], r["collection_key"]) for r in got} == cases


def test_pairs_match_brute_force(spark):
    tables = [table(spark, SF, t) for t in ("listings", "official_names", "name_aliases")]
    rows = products.identified(*tables).collect()
    want = set()
    for a, b in combinations(rows, 2):
        a, b = sorted((a, b), key=lambda r: r["id"])
        same = any(a[k] is not None and a[k] == b[k] for k in ("size_key", "collection_key"))
        if a["id"] != b["id"] and a["source"] != b["source"] and a["code"] == b["code"] and same and abs(a["mass_g"] - b["mass_g"]) <= 0.005 * max(a["mass_g"], b["mass_g"]):
            want.add((a["id"], b["id"]))
    assert {tuple(r) for r in products.find_pairs(*tables).collect()} == want


def test_groups_follow_links(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "id string, other string")
    got = {r["id"]: r["piece"] for r in products.components(both).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(21)} | {"x": "x", "y": "x"}


def test_nulls_repeats_and_empty_tables(spark):
    official = spark.createDataFrame([(1, "Hirnchoskha", "Hirnchoskha", None, "Official")], "code bigint, name string, display_name string, abbrev string, status string")
    aliases = spark.createDataFrame([], "alias string, code bigint")
    schema = "id string, source string, title string, canonical_name string, canonical_name_status string, code int"
    rows = [("a", "s1", "Hirnchoskha 5 g 1 x 2 x 3 mm", None, "unknown", 7), ("a", "s1", "Hirnchoskha 5 g 1 x 2 x 3 mm", None, "unknown", 7), ("b", "s2", "hirnchoskha, 0.1764 oz, 3 x 2 x 1 mm", "Hirnchoskha", "metbull_verified", 7), ("c", "s1", "Hirnchoskha 5 g 1 x 2 x 3 mm", None, None, 7), (None, "s3", "Hirnchoskha 5 g 1 x 2 x 3 mm", None, None, 7), ("d", None, None, None, None, 7), ("e", "s4", "Hirnchoskha 5-6 g 1 x 2 x 3 mm", None, "unknown", 7)]
    found = products.find_pairs(spark.createDataFrame(rows, schema), official, aliases).collect()
    assert sorted(tuple(r) for r in found) == [("a", "b"), ("b", "c")]
    assert products.find_pairs(spark.createDataFrame([], schema), official, aliases).count() == 0


def test_links_are_counted_without_pairs(spark):
    tables = [table(spark, SF, t) for t in ("listings", "official_names", "name_aliases")]
    pairs = [tuple(r) for r in products.find_pairs(*tables).collect()]
    groups = {r["id"]: r for r in products.group_pieces(*tables).collect()}
    for a, b in pairs:
        assert groups[a]["piece"] == groups[b]["piece"]
    count: dict = {}
    for x in (i for p in pairs for i in p):
        count[x] = count.get(x, 0) + 1
    assert {i: r["links"] for i, r in groups.items() if r["links"]} == count
    assert all(r["piece"] <= i and r["piece"] in groups for i, r in groups.items())


def test_one_piece_with_a_third_of_the_listings(spark):
    from pyspark.sql import functions as F

    hot = F.col("i") % 3 == 0
    title = F.when(hot, F.concat(F.lit("Hirnchoskha 5."), (F.col("i") % 2).cast("string"), F.lit(" g 1 x 2 x 3 mm"))).otherwise(F.concat(F.lit("Hirnchoskha 7 g 1 x 2 x "), F.col("i"), F.lit(" mm")))
    rows = spark.range(3_000).withColumnRenamed("id", "i").select(F.format_string("i%05d", "i").alias("id"), F.concat(F.lit("s"), F.col("i") % 5).alias("source"), title.alias("title"), F.lit("Hirnchoskha").alias("canonical_name"), F.lit("metbull_verified").alias("canonical_name_status"))
    official = spark.createDataFrame([(1, "Hirnchoskha", "Hirnchoskha", None, "Official")], "code bigint, name string, display_name string, abbrev string, status string")
    out = products.group_pieces(rows, official, spark.createDataFrame([], "alias string, code bigint"))
    got = {(r["piece"], r["n"], r["l"]) for r in out.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.max("links").alias("l")).collect()}
    assert got == {("i00000", 500, 400), ("i00003", 500, 400)}


def test_the_vote_names_clusters_and_ties_merge_them(spark):
    schema = "id string, source string, code bigint, mass_g double, size_key string, collection_key string, name_at double, size_at double, collection_at double"
    rows = [("a", "s1", 1, 5.0, "1x2x3", "h|1", 0.1, 0.5, 0.9), ("b", "s2", 1, 5.0, "1x2x3", None, 0.1, 0.5, 0.9), ("c", "s3", 1, 5.0, None, "h|1", 0.1, 0.5, 0.9), ("d", "s4", 1, 5.0, "1x2x3", "h|1", 0.1, 0.5, 0.9), ("e", "s5", 2, 5.0, "1x2x3", "h|1", 0.1, 0.5, 0.9)]
    votes = products.voted(products.combinations(spark.createDataFrame(rows, schema))).cache()
    assert {r["id"]: r["combination"] for r in votes.collect()} == {"a": "n1|s1x2x3|ch|1", "b": "n1|s1x2x3", "c": "n1|ch|1", "d": "n1|s1x2x3|ch|1", "e": "|s1x2x3|ch|1"}
    assert sorted(tuple(r) for r in products.same_piece_pairs(votes).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")]
