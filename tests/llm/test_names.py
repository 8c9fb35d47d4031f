"""The pigeonhole join against brute force; name mapping on small lists with nulls, ties and repeats."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siderite.llm import names, titles
from siderite.llm.names import K, SHORTEST_FUZZY

OFFICIAL = "code bigint, name string, display_name string, abbrev string, status string, note string"
ALIASES = "alias string, code bigint, origin string"
LISTED = [
    (1, "Northern Vash Plateau 9895", "NVP 9895", "NVP 9895", "Official", None), (2, "Trevane Hills 00250", "TRV 00250", "TRV 00250", "Official", None),
    (3, "Hirnchoskha", "Hirnchoskha", None, "Official", None), (4, "Mount Wovveinfor", "Mount Wovveinfor", None, "Official", None),
    (5, "Himbneilken (a)", "Himbneilken (a)", None, "Official", None), (6, "Himbneilken (b)", "Himbneilken (b)", None, "Official", None),
    (7, "Discarded Rock", "Discarded Rock", None, "Discredited", None), (8, "Skeilchômba", "Skeilchômba", None, "Official", None), (9, None, None, None, "Official", None),
]
OTHER = [("Broken Bell stone", 3, "trade name"), ("Broken Bell stone", 3, "trade name"), ("Far Lantern mass", 3, "unclear"), ("Far Lantern mass", 4, "unclear"), ("Old Rock", 7, "trade name"), (None, 1, "key")]
CASES = {
    "Northern Vash Plateau 9895 part slice 12 g": 1, "NVP-9895 | 3 g": 1, "nvp9895": 1, "N.V.P. 9895 – 4,5 g": 1, "N. Vash Plateau 9895": 1, "North Vash Plateau No. 9895": 1, "Vash Plateau northern 9895": 1,
    "Nortehrn Vash Plateau 9895": 1, "NVP 9896": 0, "TRV 250, slice": 2, "Trevane Hls 00250": 2, "hirnch0skha 2 g": 3, "Hirnc hoskha": 3, "HIRNCHOSKHA'S fragment": 3, "Hirnchosha": 3, "Hrinchoskha": 3,
    "Mt. Wovveinfor 5 x 4 x 3 mm": 4, "Moun-t Wovveinfor": 4, "Himbneilken (a) 3 g": 5, "Himbneilken meteorite b": 6, "Himbneilken": 0, "Discarded Rock 3 g": 0, "Skeilchomba": 8, "the Broken Bell stone": 3,
    "Far Lantern mass 3 g": 0, "Old Rock": 0, "Unclassified chondrite 5 g": 0, "": 0, "12.5 g": 0, "Lindqvale Collection no. 5094 Hirnchoskha": 3,
}


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTED, OFFICIAL), spark.createDataFrame(OTHER, ALIASES)


def test_titles_are_mapped(spark, lists):
    rows = [(f"i{n}", t, "extra") for n, t in enumerate(CASES)] + [("null", None, "x"), (None, "Hirnchoskha", "x"), ("i0", list(CASES)[0], "again")]
    found = {r["id"]: r["code"] for r in names.map_names(spark.createDataFrame(rows, "id string, title string, code string"), *lists).collect()}
    assert len(found) == len(CASES) + 1 and found["null"] == 0
    assert {t: found[f"i{n}"] for n, t in enumerate(CASES)} == CASES


def test_empty_tables(spark, lists):
    none = spark.createDataFrame([], "id string, title string")
    assert names.map_names(none, *lists).count() == 0
    some = spark.createDataFrame([("a", "Hirnchoskha")], "id string, title string")
    empty = names.map_names(some, lists[0].limit(0), lists[1].limit(0))
    assert [tuple(r) for r in empty.collect()] == [("a", 0)]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_pigeonhole_join_is_complete(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    forms = sorted({word(rng.randint(SHORTEST_FUZZY, 13)) for _ in range(60)})
    spans = sorted({word(rng.randint(4, 15)) for _ in range(150)} | {f[:i] + rng.choice("abcd") + f[i + rng.randint(0, 1) :] for f in forms for i in (0, len(f) // 2, len(f) - 1)})
    got = names.pigeonhole_pairs(spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(f,) for f in forms], "form string"))
    want = {(s, f, d) for s in spans for f in forms if len(s) >= SHORTEST_FUZZY - K and (d := levenshtein(s, f)) <= K}
    assert {tuple(r) for r in got.select("span", "form", "distance").collect()} == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text_has_words(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert titles.name_words(rows, "t", "w").where("w IS NULL").count() == 0
