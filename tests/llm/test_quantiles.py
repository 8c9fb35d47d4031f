"""Rank-interval summaries against exact ranks."""

import numpy as np

from siderite.llm import quantiles

DATA = "day int, k string, v double, n int"


def data(seed=3, n=20_000):
    rng = np.random.default_rng(seed)
    key = rng.choice(["hot", "hot", "hot", "warm", "cold"], n)
    value = np.where(key == "warm", rng.integers(0, 4, n), rng.lognormal(0, 3, n))
    return [(int(d), str(k), float(v), 1) for d, k, v in zip(rng.integers(0, 5, n), key, value)] + [(1, None, 1.0, 1), (1, "hot", None, 1), (1, "hot", float("nan"), 1), (2, "one", 5.0, 1), (2, "edge", float("inf"), 1)]


def exact(values, row):
    v = np.sort(values)
    return np.searchsorted(v, row["value"], "left") + 1, np.searchsorted(v, row["value"], "right")


def test_percentiles_stay_within_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_OUT", 3)  # a tree of several levels, which together add no more than one would
    all_rows = data()
    df = spark.createDataFrame(all_rows, DATA).repartition(12)
    parts = quantiles.summaries(df, ["k"], "v", ["day"], share=0.005)
    days = quantiles.merge_summaries(parts, ["day", "field", "key_value"], 0.005)
    both = {
        "day": quantiles.percentiles(days, ["day", "field", "key_value"], [0.0, 0.1, 0.5, 0.99, 1.0]),
        "all": quantiles.percentiles(quantiles.merge_summaries(days, ["field", "key_value"], 0.005, "day"), ["field", "key_value"], [0.0, 0.1, 0.5, 0.99, 1.0]),
    }
    for name, out in both.items():
        found = out.collect()
        assert {r["key_value"] for r in found} == {"hot", "warm", "cold", "one", "edge"}
        for r in found:
            values = np.array([v for d, k, v, _ in all_rows if k == r["key_value"] and v is not None and v == v and (name == "all" or d == r["day"])])
            low, high = exact(values, r)
            assert r["n"] == len(values) and low <= r["rank_high"] and high >= r["rank_low"]
            assert max(low - r["rank"], r["rank"] - high, 0) <= max(1, 3 * 0.005 * len(values))
            assert max(r["rank_high"] - r["rank"], r["rank"] - r["rank_low"]) <= max(1, 3 * 0.005 * len(values))


def test_merge_tuples_gives_true_intervals():
    rng = np.random.default_rng(8)
    parts, values = [], []
    for p in range(6):
        v = np.sort(rng.integers(0, 50, rng.integers(1, 80))).astype(float)
        keep = quantiles._compress(np.zeros(v.size, int), np.arange(1, v.size + 1), np.arange(1, v.size + 1), np.full(v.size, v.size), 0.05)
        rank = keep + 1
        parts.append((v[keep], np.diff(np.r_[0, rank]), np.full(keep.size, p), np.full(keep.size, v.size)))
        values.append(v)
    vals, g, part, n = (np.concatenate(x) for x in zip(*parts))
    _, merged, rmin, rmax, total = quantiles.merge_tuples(np.zeros(vals.size, int), part, vals, g, np.zeros(vals.size, int), n)
    every = np.sort(np.concatenate(values))
    assert total[0] == every.size
    for v, lo, hi in zip(merged, rmin, rmax):
        assert np.searchsorted(every, v, "left") + 1 <= hi and np.searchsorted(every, v, "right") >= lo


def test_empty(spark):
    parts = quantiles.summaries(spark.createDataFrame([], DATA), ["k"], "v", ["day"])
    merged = quantiles.merge_summaries(parts, ["field", "key_value"])
    assert quantiles.percentiles(merged, ["field", "key_value"], [0.5]).count() == 0
