"""Packing: every token once, no container overfull, no needless split, close to the bound; token counts."""

import random

from siderite.llm import packing, tokens


def check(spark, sizes, kinds):
    docs = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, bin_id string")
    boxes = spark.createDataFrame(kinds, "container string, capacity_tokens int")
    placed = packing.pack(docs, boxes, block_items=60, offspring=10).collect()
    for name, capacity in {k for k in kinds if k[0] and k[1] and k[1] > 0}:
        mine = [r for r in placed if r["container"] == name]
        held: dict = {}
        for r in mine:
            held[r["bin_id"]] = held.get(r["bin_id"], 0) + r["token_end"] - r["token_start"]
        assert all(0 < h <= capacity for h in held.values())
        want = sorted(t for d, t, _ in sizes if d is not None and t and t > 0)
        assert sum(held.values()) == sum(want)
        by_doc: dict = {}
        for r in mine:
            by_doc.setdefault((r["doc_id"], r["part"].split(".")[0]), []).append((r["token_start"], r["token_end"]))
        assert sorted(max(e for _, e in spans) for spans in by_doc.values()) == want
        for spans in by_doc.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(spans) == -(-spans[-1][1] // capacity)
        yield name, len(held), -(-sum(want) // capacity)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randint(1, 90), "x") for i in range(400)] + [(900, 1000, "x"), (901, 256, "x"), (902, 100, "x")]
    for name, bins, least in check(spark, sizes, [("small", 100), ("large", 512)]):
        assert bins <= least * (1.05 if name == "small" else 1.03) + 1, (name, bins, least)


def test_nulls_ties_repeats_and_empty(spark):
    sizes = [(1, 10, "x"), (1, 10, "x"), (2, None, "x"), (None, 5, "x"), (3, 0, "x"), (4, 50, None)]
    list(check(spark, sizes, [("a", 40), ("a", 40), (None, 10), ("b", 0), ("c", None)]))
    empty = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(empty, spark.createDataFrame([("a", 10)], "container string, capacity_tokens int")).count() == 0


def test_crossover_keeps_every_item():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 60) for _ in range(120)), reverse=True)
    a, b = packing.evolve(sizes, 100, [], 0, rng)[:1] * 2
    child = packing.crossover(a, b[::-1], sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(120)) and all(sum(sizes[i] for i in x) <= 100 for x in child)


def test_token_counts(spark):
    texts = ["One small stone, 12.5 g.", "", None, "schön " * 3000, "a" * 9000, "<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(rows).collect()}
    code = tokens.encoder()
    assert got[0] == len(code.encode_ordinary(texts[0])) and got[1] == got[2] == 0 and got[5] > 1
    assert got[3] == len(code.encode_ordinary(texts[3])) and got[4] == len(code.encode_ordinary(texts[4]))


def test_long_runs_count_as_the_tokenizer_counts_them():
    code = tokens.encoder()
    for text in ("-" * 5_000, "9" * 5_000, "x" + " " * 4_000 + "y", " " * 3_000, "a\n" * 2_000 + "\n" * 2_500, "a" + "\t " * 1_500 + "\nb" + " " * 1_000, " " * 1_200 + "q" + " " * 1_200):
        assert tokens.count_tokens(code, text) == len(code.encode_ordinary(text)), text[:5]
    assert tokens.count_tokens(code, "-" * 5_000) == 79
    assert tokens.count_tokens(code, " " * 2_000_000 + "end") > 1_000  # the pattern alone can't hold such a run


def test_blocks_of_few_containers_end(spark):
    sizes = spark.range(400).selectExpr("id AS doc_id", "cast(1 + id % 3 AS bigint) AS tokens")
    boxes = spark.createDataFrame([("wide", 5_000), ("tight", 9)], "container string, capacity_tokens int")
    packed = packing.pack(sizes, boxes, block_items=20, offspring=4).cache()
    assert {r["container"]: tuple(r)[1:] for r in packing.placement_faults(packed, sizes, boxes).collect()} == {"wide": (400, 0, 0, 0), "tight": (400, 0, 0, 0)}
    assert packed.where("container = 'wide'").select("bin_id").distinct().count() == 1


def test_exchange_fills_containers():
    rng = random.Random(3)
    bins, fills = [[0, 1]], [90]
    free = packing.exchange(bins, fills, [2, 3], [50, 40, 45, 30], 100, rng)
    assert sorted(bins[0] + free) == [0, 1, 2, 3] and fills == [sum([50, 40, 45, 30][i] for i in bins[0])] and 90 < fills[0] <= 100
