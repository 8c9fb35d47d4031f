"""One name, text, source or combination with a third of all rows: whole results, no group in one piece."""

from pyspark.sql import functions as F

from siderite.llm import mixing, names, packing, truncation


def test_one_title_with_a_third_of_the_rows(spark):
    rows = spark.range(9_000).select(F.concat(F.lit("i"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "Hirnchosha slice 3 g").otherwise(F.concat(F.lit("Rock "), "id", F.lit(" 5 g"))).alias("title"))
    official = spark.createDataFrame([(1, "Hirnchoskha", None, None, "Official")], "code bigint, name string, display_name string, abbrev string, status string")
    out = names.map_names(rows, official, spark.createDataFrame([], "alias string, code bigint"))
    assert {r["code"]: r["count"] for r in out.groupBy("code").count().collect()} == {0: 6_000, 1: 3_000}


def test_one_text_with_a_third_of_the_documents(spark):
    sentence = "The crust is thin and dark, with flow lines near the rim. "
    text = F.when(F.col("id") % 3 == 0, sentence * 6 + "We measured it at").otherwise(F.concat(F.lit(sentence * 5), F.lit("Stone "), F.col("id").cast("string"), F.lit(" is listed, and we measured it at 21 mm.")))
    out = truncation.cut_documents(spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text")))
    assert {r["cut"]: r["count"] for r in out.groupBy("cut").count().collect()} == {True: 1_000, False: 2_000}


def test_a_hot_text_is_judged_like_a_single_one(spark):
    sentence = "The crust is thin and dark, with flow lines near the rim. "
    rest = F.concat(F.lit(sentence * 2), F.lit("Stone "), F.col("id").cast("string"), F.lit(" is listed.\nWe measured it at 21 mm on Monday. It was sold."))
    for hot, cut in ((sentence + "Nobody asked for herringbone.", False), (sentence + "\nWe meas", True)):
        for copies in (1, 5_000):
            rows = spark.range(1_000 + copies).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") >= 1_000, hot).otherwise(rest).alias("text"))
            out = truncation.cut_documents(rows)
            assert {(r["cut"], r["count"]) for r in out.where("doc_id >= 1000").groupBy("cut").count().collect()} == {(cut, copies)}, (hot, copies)
            assert out.where("doc_id < 1000 AND cut").count() == 0


def test_one_source_and_one_size_with_a_third_of_the_documents(spark):
    sized = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("en").alias("lang"), F.lit("x").alias("topic"), (F.lit(20) + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).cast("bigint").alias("tokens"))
    drawn = mixing.mix(sized, spark.createDataFrame([("m", "hot", 0.5, 3), ("m", "s1", 0.5, 9)], "mix string, source string, target_share double, max_repeats int"))
    held = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(held["hot"] / sum(held.values()) - 0.5) < 0.005
    packed = packing.pack(sized, spark.createDataFrame([("a", 100)], "container string, capacity_tokens int"), offspring=4)
    bins = packed.groupBy("bin_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("h"))
    assert packed.count() == 6_000 and bins.where("h > 100").count() == 0
