"""Per-key results without a task that carries a hot key (problem 5): eager aggregation through joins.

Both inputs shrink to one small state for each key and task before anything moves; states are merged, joined
and rolled up algebraically: the pairs of a key are count x count, a sum over the pairs is sum x count.
A key that holds a third of all rows costs its tasks one state each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: list[str], value: str, moment: str, prefix: str) -> DataFrame:
    """(field, key_value, <prefix>rows, <prefix>values, <prefix>sum, <prefix>min, <prefix>max, <prefix>newest).

    One row for each value of each column in ``keys``; the null key has a row too, so rows of a field sum to
    those of the table. Nulls and NaN in ``value`` count as rows, not as values.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_value")) for k in keys]))
    number = F.when(~F.isnan(value), F.col(value))
    long = df.select(each.alias("_k"), number.cast("double").alias("_v"), F.col(moment).alias("_t")).select("_k.field", "_k.key_value", "_v", "_t")
    states = [F.count(F.lit(1)).alias(f"{prefix}rows"), F.count("_v").alias(f"{prefix}values"), F.sum("_v").alias(f"{prefix}sum"), F.min("_v").alias(f"{prefix}min"), F.max("_v").alias(f"{prefix}max"), F.max("_t").alias(f"{prefix}newest")]
    return long.groupBy("field", "key_value").agg(*states)


def eager_key_stats(left: DataFrame, right: DataFrame, keys: list[str], value: str, moment: str) -> DataFrame:
    """What joining left and right by each key would give per key, without building the join.

    Columns: those of :func:`key_states` with prefixes l_ and r_, ``pairs`` (rows of the inner join), ``pair_sum``
    (sum of left's value over them). Every key of either side has its row, the null key too: a key that one side
    lacks has 0 rows and values there and no range, so l_rows and r_rows of a field sum to the rows of the two
    tables. ``pairs`` and ``pair_sum`` are 0 where a key is null or on one side only.
    """
    a, b = key_states(left, keys, value, moment, "l_"), key_states(right, keys, value, moment, "r_")
    b = b.withColumnsRenamed({"field": "_field", "key_value": "_key"})
    # the compact states meet null-safely, at most one of each side for a key
    met = a.join(b, (F.col("field") == F.col("_field")) & F.col("key_value").eqNullSafe(F.col("_key")), "full")
    counts = [f"{p}_{c}" for p in "lr" for c in ("rows", "values")]
    whole = met.withColumns({"field": F.coalesce("field", "_field"), "key_value": F.coalesce("key_value", "_key")} | {c: F.coalesce(c, F.lit(0)) for c in counts}).drop("_field", "_key")
    joins = F.col("key_value").isNotNull() & (F.col("l_rows") > 0) & (F.col("r_rows") > 0)
    return whole.withColumns({"pairs": F.when(joins, F.col("l_rows") * F.col("r_rows")).otherwise(0), "pair_sum": F.when(joins, F.coalesce("l_sum", F.lit(0.0)) * F.col("r_rows")).otherwise(0.0)})


def heavy_keys(states: DataFrame, rows: str, least_share: float) -> DataFrame:
    """(field, key_value) of the non-null keys that hold at least ``least_share`` of the field's rows.

    ``states`` has one row for each key, null key included; the totals come from these states.
    """
    totals = states.groupBy("field").agg(F.sum(rows).alias("_total"))
    return states.where("key_value IS NOT NULL").join(totals, "field").where(F.col(rows) >= F.lit(least_share) * F.col("_total")).select("field", "key_value")
