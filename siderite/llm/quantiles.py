"""Percentiles of very large numeric columns with a tracked error (problem 6).

A summary is a sorted list of tuples (value, g, delta): the tuple's value has a rank between rmin, the sum of g
up to it, and rmin + delta. Summaries are made for each task without moving a row, merged in a tree of bounded
fan-out, and compressed by the permitted uncertainty after each merge; the rank intervals stay true throughout,
so every percentile comes with the bound that really holds for it. Summaries of partitions, snapshots or days
can be kept and merged later, in any order, on one condition only: they say what they cover.

Python runs on whole Arrow columns, never by row: a group of summaries is one sort and a few running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siderite.session import stored

#: Rows that one summary run sorts at once; it bounds a task's memory.
RUN_ROWS = 500_000
#: Values of ``leaf`` that one merge takes at most, and how many summaries a group of keys brings to it on average.
FAN_OUT, GROUP_SUMMARIES = 64, 1_000

LISTS = "vals array<double>, g array<bigint>, delta array<bigint>"


def _segments(code: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins."""
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if code.size else np.zeros(0, np.int64)


def _compress(code: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Which tuples to keep: of each step of 2 x share x n ranks the last one, and each key's first and last."""
    step = np.maximum(1, np.floor(2 * share * total)).astype(np.int64)
    slot = (rmin - 1) // step
    last = np.r_[(code[1:] != code[:-1]) | (slot[1:] != slot[:-1]), True]
    last[_segments(code)] = True
    return np.flatnonzero(last)


def _rows(keys: dict[str, pa.Array], code: np.ndarray, vals: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, total: np.ndarray, keep: np.ndarray) -> dict[str, pa.Array]:
    """Arrow columns with one row for each code, in the order of the codes."""
    kept = code[keep]
    first = _segments(kept)
    previous = np.r_[0, rmin[keep][:-1]]
    previous[first] = 0
    offsets = pa.array(np.r_[first, kept.size].astype(np.int32))
    lists = {"vals": vals[keep], "g": rmin[keep] - previous, "delta": (rmax - rmin)[keep]}
    columns = {k: v.take(pa.array(kept[first])) for k, v in keys.items()}
    columns["n"] = pa.array(total[keep][first].astype(np.int64))
    return columns | {k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in lists.items()}


def summaries(df: DataFrame, keys: list[str], value: str, by: list[str] | None = None, share: float = 0.002) -> DataFrame:
    """(<by>, field, key_value, leaf, n, vals, g, delta): a summary for each task and each value of each key column.

    ``by`` names columns that stay apart (a snapshot, a day). Null keys, null and NaN values are left out;
    infinite values count. Each summary's rank intervals are off by at most ``share`` x n. No exchange.
    """
    by = by or []
    kinds = {k: kind for k, kind in df.dtypes}
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "field string, key_value string, leaf int, n bigint", LISTS])
    source = df.select(*by, *(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId()
        v = table["_v"].to_numpy()
        for i, name in enumerate(keys):
            parts = [table[b].combine_chunks().dictionary_encode() for b in by] + [table[f"_k{i}"].combine_chunks().dictionary_encode()]
            there = ~np.asarray(parts[-1].indices.is_null())
            code = np.zeros(there.sum(), np.int64)
            for p in parts:
                code = code * (len(p.dictionary) + 1) + np.asarray(p.indices.fill_null(len(p.dictionary)))[there]
            if not code.size:
                continue
            rank_by = np.lexsort((v[there], code))
            row_of = np.flatnonzero(there)[rank_by]
            code, x = code[rank_by], v[there][rank_by]
            first = _segments(code)
            size = np.diff(np.r_[first, code.size])
            dense = np.repeat(np.arange(first.size), size)
            rmin = np.arange(code.size) - first[dense] + 1
            keep = _compress(dense, rmin, rmin, size[dense], share)
            names = {b: table[b].combine_chunks().take(pa.array(row_of[first])) for b in by}
            names["field"] = pa.array([name] * first.size, pa.string())
            names["key_value"] = table[f"_k{i}"].combine_chunks().take(pa.array(row_of[first]))
            names["leaf"] = pa.array(np.full(first.size, leaf, np.int32))
            yield pa.RecordBatch.from_pydict(_rows(names, dense, x, rmin, rmin, size[dense], keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from one(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from one(pa.Table.from_batches(held))

    return source.mapInArrow(run, schema)


def merge_tuples(code: np.ndarray, part: np.ndarray, vals: np.ndarray, g: np.ndarray, delta: np.ndarray, n_part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge the summaries ``part`` of each key ``code`` (tuples in the summaries' own order); exact rank intervals.

    A tuple's lower rank grows by the lower ranks of the other summaries' tuples before it; its upper rank by
    what each other summary's next tuple may still hide below: g + delta - 1 of that tuple, nothing past the last.
    Returns code, vals, rmin, rmax, n by code, sorted by code and value.
    """
    hides = g + delta - 1
    same = np.r_[part[1:] == part[:-1], False]
    hidden_by_next = np.where(same, np.r_[hides[1:], 0], 0)
    starts = np.r_[True, part[1:] != part[:-1]]
    order = np.lexsort((np.arange(code.size), vals, code))
    c = code[order]
    first = _segments(c)
    dense = np.repeat(np.arange(first.size), np.diff(np.r_[first, c.size]))
    total = np.bincount(code[starts], weights=n_part[starts], minlength=int(c.max()) + 1).astype(np.int64) if c.size else np.zeros(0, np.int64)
    at_start = np.bincount(code[starts], weights=hides[starts], minlength=total.size).astype(np.int64)

    def running(x: np.ndarray) -> np.ndarray:
        summed = np.cumsum(x)
        return summed - np.r_[0, summed[first[1:] - 1]][dense]

    rmin = running(g[order])
    open_after = at_start[c] + running((hidden_by_next - hides)[order])
    rmax = rmin + delta[order] + open_after - hidden_by_next[order]
    return c, vals[order], rmin, np.maximum(rmax, rmin), total[c]


def _merge_table(table: pa.Table, keys: list[str], share: float) -> pa.Table:
    parts = [table[k].combine_chunks().dictionary_encode() for k in keys]
    code = np.zeros(table.num_rows, np.int64)
    for p in parts:
        code = code * (len(p.dictionary) + 1) + np.asarray(p.indices.fill_null(len(p.dictionary)))
    _, row_of, code = np.unique(code, return_index=True, return_inverse=True)
    lists = {k: table[k].combine_chunks() for k in ("vals", "g", "delta")}
    length = np.asarray(lists["vals"].value_lengths())
    flat = {k: np.asarray(v.flatten()) for k, v in lists.items()}
    spread = np.repeat(np.arange(table.num_rows), length)
    c, vals, rmin, rmax, total = merge_tuples(code[spread], spread, flat["vals"], flat["g"], flat["delta"], np.asarray(table["n"])[spread])
    keep = _compress(c, rmin, rmax, total, share)
    names = {k: table[k].combine_chunks().take(pa.array(row_of)) for k in keys}
    return pa.table(_rows(names, c, vals, rmin, rmax, total, keep))


def _final_merge(keys: list[str], share: float) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _merge_table(table, keys, share)


def _block_merge(keys: list[str], share: float) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = _merge_table(table, keys, share)
        return out.append_column("leaf", pa.array(np.full(out.num_rows, key[1].as_py(), np.int32)))

    return run


def merge_summaries(parts: DataFrame, keys: list[str], share: float = 0.002, leaf: str = "leaf") -> DataFrame:
    """(<keys>, n, vals, g, delta): the summaries of each key merged to one, by a tree of fan-out FAN_OUT.

    ``leaf`` counts from 0 and says which summaries are merged first. However many levels the tree has, it adds at
    most ``share`` x n to the rank error, each level its part of that, and the intervals say how much it really
    added. A hot key costs each merge FAN_OUT leaves; keys are spread over as many groups as their number asks for.
    """
    kinds = dict(parts.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = stored(parts)
    seen = parts.agg(F.max(leaf).alias("last"), F.count(F.lit(1)).alias("summaries")).first()  # two numbers
    leaves = (seen["last"] or 0) + 1
    levels = 1
    while FAN_OUT**levels < leaves:
        levels += 1
    key_groups = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen["summaries"] // GROUP_SUMMARIES)
    for level in range(levels):
        last = level == levels - 1
        group = F.pmod(F.xxhash64(*keys), F.lit(key_groups)).cast("int").alias("_group")
        block = F.lit(0) if last else (F.col(leaf) / FAN_OUT).cast("int")
        keyed = parts.select(*keys, "n", "vals", "g", "delta", group, block.alias("_block"))

        merge = _final_merge(keys, share / levels) if last else _block_merge(keys, share / levels)
        parts = keyed.groupBy("_group", "_block").applyInArrow(merge, f"{named}, n bigint, {LISTS}" + ("" if last else ", leaf int"))
        leaf = "leaf"
    return parts


def percentiles(merged: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(<keys>, n, q, value, rank, rank_low, rank_high): for each probability q the value of rank ceil(q x n).

    ``value`` occurs in the data; its true rank lies between rank_low and rank_high, both inclusive.
    """
    kinds = dict(merged.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch["vals"].value_lengths())
            vals, g, delta = (np.asarray(batch[k].flatten()) for k in ("vals", "g", "delta"))
            n = np.asarray(batch["n"])
            row = np.repeat(np.arange(batch.num_rows), length)
            first = np.r_[0, np.cumsum(length)[:-1]]
            summed = np.cumsum(g)
            rmin = summed - np.r_[0, summed][first][row]
            rmax = rmin + delta
            lift = int(n.max()) + 1
            for q in probabilities:
                rank = np.clip(np.ceil(q * n), 1, n).astype(np.int64)
                above = np.minimum(np.searchsorted(rmin + row * lift, rank + np.arange(batch.num_rows) * lift), first + length - 1)
                below = np.maximum(above - 1, first)
                off = lambda i, rank=rank: np.maximum(rank - rmin[i], rmax[i] - rank)
                best = np.where(off(below) < off(above), below, above)
                columns = {k: batch[k] for k in keys}
                yield pa.RecordBatch.from_pydict(columns | {"n": batch["n"], "q": pa.array(np.full(batch.num_rows, q)), "value": pa.array(vals[best]), "rank": pa.array(rank), "rank_low": pa.array(rmin[best]), "rank_high": pa.array(rmax[best])})

    return merged.mapInArrow(run, f"{named}, n bigint, q double, value double, rank bigint, rank_low bigint, rank_high bigint")
