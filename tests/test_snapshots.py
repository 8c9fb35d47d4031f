"""Snapshot changes on hand-made deliveries and against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siderite.functions.urls import plain_url
from siderite.operators.snapshots import latest_states, snapshot_changes

SCHEMA = "snapshot_id int, url string, price double, available boolean, scraped_at timestamp, change string"
T = lambda h: dt.datetime(2026, 5, 1, h)


def changes(spark, rows, runs=None):
    df = spark.createDataFrame(rows, SCHEMA)
    known = None if runs is None else spark.createDataFrame([(r,) for r in runs], "snapshot_id int")
    return sorted(tuple(r) for r in snapshot_changes(df, known).collect())


def test_plain_urls(spark):
    cases = {
        "https://a.example/x": "https://a.example/x", "http://WWW.A.example/x/": "https://a.example/x", "https://a.example/x?id=5&ref=z#top": "https://a.example/x?id=5", "https://a.example/x?utm=1": "https://a.example/x",
        "https://a.example/X/Y?b=1&id=7": "https://a.example/X/Y?id=7", "https://a.example/": "https://a.example", "HTTPS://A.EXAMPLE": "https://a.example", None: None, "": "https://", "https://a.example/x?xid=5": "https://a.example/x",
    }
    got = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["p"] for r in got.select("url", plain_url(got.url).alias("p")).collect()} == cases


def test_added_removed_changed(spark):
    u = "https://a.example/"
    rows = [
        (1, u + "a", 1.0, True, T(1), "x"), (2, u + "a", 1.0000001, True, T(2), "x"),  # float noise
        (1, u + "b", 1.0, True, T(1), "x"), (2, u + "b", None, True, T(2), "x"),  # a price goes
        (1, u + "c", None, True, T(1), "x"), (2, "http://www.a.example/c/", None, True, T(2), "x"),  # no price on both sides
        (1, u + "d", 1.0, True, T(1), "x"), (2, u + "e", 1.0, True, T(2), "x"),
        (1, u + "f", 9.0, True, T(1), "x"), (1, u + "f", 1.0, True, T(3), "x"), (1, u + "f", 1.0, True, T(3), "x"), (2, u + "f", 1.0, False, T(2), "x"),
        (1, None, 1.0, True, T(1), "x"), (None, u + "g", 1.0, True, T(1), "x"), (2, u + "h", float("nan"), None, None, "x"), (1, u + "h", None, None, T(1), "x"),
    ]
    want = [(2, u + "b", "changed"), (2, u + "d", "removed"), (2, u + "e", "added"), (2, u + "f", "changed")]
    assert changes(spark, rows) == want
    assert changes(spark, rows, [1, 2]) == want
    # a run that delivered nothing still ends and begins a pair
    gone = changes(spark, [(1, u + "a", 1.0, True, T(1), "x"), (5, u + "a", 1.0, True, T(1), "x")], [1, 3, 5])
    assert gone == [(3, u + "a", "removed"), (5, u + "a", "added")]
    assert changes(spark, []) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 4), f"https://a.example/{rng.randint(1, 25)}", rng.choice([None, 1.0, 1.004, 2.5]), rng.choice([True, False, None]), T(0) + dt.timedelta(seconds=i), "x") for i in range(400)]
    state: dict = {}
    for s, u, p, a, t, _ in rows:
        state[s, u] = (None if p is None else round(p * 100), a)
    want = []
    for s in (2, 3, 4):
        old, new = ({u: v for (x, u), v in state.items() if x == k} for k in (s - 1, s))
        want += [(s, u, "added") for u in new.keys() - old.keys()] + [(s, u, "removed") for u in old.keys() - new.keys()] + [(s, u, "changed") for u in new.keys() & old.keys() if new[u] != old[u]]
    assert changes(spark, rows) == sorted(want)


def test_against_literal_except_all_and_full_join(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), f"https://a.example/{i % 40}", rng.choice([None, 1.0, 2.5, 1e15, 1e15 + 1, -3e16, float("inf")]), rng.choice([True, False, None]), T(0) + dt.timedelta(seconds=i), "x") for i in range(300)]
    states = latest_states(spark.createDataFrame(rows, SCHEMA)).cache()
    want = []
    for s in (2, 3):
        old, new = (states.where(f"snapshot_id = {k}").select("url", "state") for k in (s - 1, s))
        gone, come = old.exceptAll(new).select("url", F.lit(1).alias("o")), new.exceptAll(old).select("url", F.lit(1).alias("n"))
        for r in gone.join(come, "url", "full").collect():
            want.append((s, r["url"], "changed" if r["o"] and r["n"] else "added" if r["n"] else "removed"))
    assert changes(spark, rows) == sorted(want)


def test_huge_prices_are_told_apart(spark):
    u = "https://a.example/"
    rows = [(1, u + "a", 1e15, True, T(1), "x"), (2, u + "a", 2e15, True, T(2), "x"), (1, u + "b", 1e300, True, T(1), "x"), (2, u + "b", 1e300, True, T(2), "x"), (1, u + "c", -1e18, True, T(1), "x"), (2, u + "c", 1e18, True, T(2), "x"), (1, u + "d", 9.9e14, True, T(1), "x"), (2, u + "d", 9.9e14 + 1, True, T(2), "x")]
    assert changes(spark, rows) == [(2, u + "a", "changed"), (2, u + "c", "changed"), (2, u + "d", "changed")]
