"""Mixing: shares within a small text of their target, caps kept, unreachable targets reported."""

import random

import numpy as np
import pandas as pd

from siderite.llm import mixing

SIZED = "doc_id bigint, source string, lang string, topic string, tokens bigint, mix string"
TARGETS = "mix string, source string, target_share double, max_repeats int"


def corpus():
    rng = random.Random(4)
    rows = [(i, "big", rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), rng.randint(5, 800), "x") for i in range(600)]
    rows += [(1000 + i, "mid", "en", "a", rng.randint(5, 800), "x") for i in range(150)]
    return rows + [(2000 + i, "tiny", "fr", "b", rng.randint(5, 60), "x") for i in range(5)] + [(3000, None, "en", "a", 9, "x"), (None, "mid", "en", "a", 9, "x"), (3001, "mid", "en", "a", 0, "x"), (3002, "mid", "en", "a", None, "x")]


def test_shares_are_reached(spark):
    rows = corpus()
    sized = spark.createDataFrame(rows, SIZED)
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "mid", 0.4, 3), ("m", "tiny", 0.1, 4), ("n", "mid", 1.0, 1), ("n", "none", 0.5, 1), (None, "big", 1.0, 1)], TARGETS)
    size = sum(r[4] for r in rows if r[0] is not None and r[1] is not None and r[4])
    drawn = mixing.mix(sized, targets, size).collect()
    caps = {("m", "big"): 2, ("m", "mid"): 3, ("m", "tiny"): 4, ("n", "mid"): 1}
    assert all(0 < r["copies"] <= caps[(r["mix"], r["source"])] for r in drawn) and len({(r["mix"], r["doc_id"]) for r in drawn}) == len(drawn)
    held = lambda m, s: sum(r["tokens"] * r["copies"] for r in drawn if (r["mix"], r["source"]) == (m, s))
    assert abs(held("m", "big") - 0.5 * size) < 60 and abs(held("m", "mid") - 0.4 * size) < 60
    assert held("m", "tiny") == 4 * sum(r[4] for r in rows if r[1] == "tiny")
    report = {(r["mix"], r["source"]): r for r in mixing.share_report(spark.createDataFrame(drawn), targets.where("mix IS NOT NULL")).collect()}
    assert report[("n", "none")]["reached_share"] == 0 and report[("n", "none")]["texts"] == 0
    assert abs(sum(r["reached_share"] for r in report.values() if r["mix"] == "m") - 1) < 1e-9


def test_raking_meets_margins_where_it_can():
    cells = pd.DataFrame([(s, l, t, k, sh, 9) for (s, sh) in (("a", 0.7), ("b", 0.3)) for l in ("en", "de") for t, k in (("x", 100), ("y", 300))], columns=["source", "lang", "topic", "tokens", "target_share", "max_repeats"])
    cells.loc[0, "tokens"] = 500
    weight = mixing.rake(cells, 1000.0)
    used = cells.assign(u=weight * cells["tokens"])
    assert np.allclose(used.groupby("source")["u"].sum(), [700, 300])
    want = cells.groupby("lang")["tokens"].sum() / cells["tokens"].sum() * 1000
    assert np.allclose(used.groupby("lang")["u"].sum(), want, rtol=1e-3)
    assert (mixing.rake(cells.assign(max_repeats=1), 10_000.0) <= 1 + 1e-9).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SIZED)
    assert mixing.mix(none, spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)).count() == 0
    assert mixing.mix(spark.createDataFrame(corpus(), SIZED), spark.createDataFrame([], TARGETS)).count() == 0


def test_equal_texts_are_one(spark):
    rows = [(i, "a", "en", "x", 10, "k1" if i < 3 else f"k{i}") for i in range(6)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens bigint, text_key string")
    drawn = {r["doc_id"]: r["copies"] for r in mixing.mix(sized, spark.createDataFrame([("m", "a", 1.0, 2)], TARGETS), 1000).collect()}
    assert drawn == {0: 2, 3: 2, 4: 2, 5: 2}


def test_the_scarcest_source_sets_the_size_by_default(spark):
    rows = corpus()
    sized = spark.createDataFrame([(*r[:5], f"k{i}") for i, r in enumerate(rows)], "doc_id bigint, source string, lang string, topic string, tokens bigint, text_key string")
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "mid", 0.4, 3), ("m", "tiny", 0.1, 4), ("n", "big", 0.6, 1), ("n", "none", 0.4, 1)], TARGETS)
    drawn = mixing.mix(sized, targets)
    held = {(r["mix"], r["source"]): r["t"] for r in drawn.selectExpr("mix", "source", "tokens * copies AS t").groupBy("mix", "source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    tiny = 4 * sum(r[4] for r in rows if r[1] == "tiny")
    assert held["m", "tiny"] == tiny and abs(held["m", "big"] - 5 * tiny) < 200 and abs(held["m", "mid"] - 4 * tiny) < 200
    faults = {r["mix"]: tuple(r)[1:] for r in mixing.mix_faults(drawn, targets, sized).collect()}
    assert faults == {"m": (3, 0, 0, 0, 0), "n": (2, 0, 0, 0, 0)}


def test_texts_longer_than_a_budget_are_not_used(spark):
    rows = [(i, "a", "en", "x", 10) for i in range(100)] + [(200 + i, "b", "en", "x", 10) for i in range(20)] + [(300, "b", "en", "x", 5_000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic string, tokens bigint")
    drawn = mixing.mix(sized, spark.createDataFrame([("m", "a", 0.9, 3), ("m", "b", 0.1, 3)], TARGETS), 1_000).collect()
    held = {s: sum(r["tokens"] * r["copies"] for r in drawn if r["source"] == s) for s in "ab"}
    assert held == {"a": 900, "b": 100} and 300 not in {r["doc_id"] for r in drawn}


def test_a_text_of_several_sources_serves_each_mix_from_its_own(spark):
    sized = spark.createDataFrame([(1, "other", "en", "x", 10, "k"), (2, "a", "en", "x", 10, "k"), (3, "a", "en", "x", 10, "l")], "doc_id bigint, source string, lang string, topic string, tokens bigint, text_key string")
    drawn = mixing.mix(sized, spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS), 20).collect()
    assert {r["doc_id"] for r in drawn} == {2, 3}
