"""What changed between full snapshots (problem 3).

Every row of every full delivery is reduced to one state for each (snapshot, url), each state is compared
with its neighbours' by EXCEPT ALL in both directions, and the residues are joined by key to tell added,
removed and changed apart. All consecutive pairs go through one plan.

Plan: a hash aggregate with map-side combine (a url that holds a third of all rows shrinks to one row per
task before it moves) and its exchange by (snapshot, url), then one exchange of the states by url, and from
there no further one: the signed count that is EXCEPT ALL in both directions and the co-grouped full join of
its residues are both clustered by url. One exchange of all rows by url would save the second, but bring every
row of a hot url to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderite.functions.urls import plain_url
from siderite.session import small_side

#: A state is one whole number: ((cents + OFFSET) * 3 + available) below STATE_SPAN, so that a plain max() finds the newest.
CENT_LIMIT = 10**17
STATE_SPAN = 10**18
MICRO_SHIFT = 10**17


def state_code(price: Column, available: Column) -> Column:
    """Price in hundredths and availability as one BIGINT; null, NaN and infinite prices share the code of no price.

    Prices from 1e15 on, whose hundredths no double tells apart, are told apart by a hash of their value. A null
    ``available`` is a value of its own.
    """
    usable = price.isNotNull() & ~F.isnan(price) & (F.abs(price) < F.lit(float("inf")))
    small = F.abs(price) < F.lit(CENT_LIMIT / 100.0)
    hashed = F.pmod(F.xxhash64(price), F.lit(CENT_LIMIT)) + F.lit(2 * CENT_LIMIT + 2)
    cents = F.when(small, F.round(F.when(small, price * 100)).cast("bigint") + F.lit(CENT_LIMIT + 1)).otherwise(hashed)
    flag = F.when(available.isNull(), 0).when(available, 2).otherwise(1)
    return F.when(usable, cents).otherwise(F.lit(0)).cast("bigint") * F.lit(3).cast("bigint") + flag


def latest_states(snapshots: DataFrame) -> DataFrame:
    """One row for each (snapshot_id, url): the state of the row with the latest ``scraped_at``.

    Of rows read at the same moment the higher state code holds, a null ``scraped_at`` is the oldest. Rows
    without url or snapshot_id have no key and take no part.
    """
    micros = F.coalesce(F.unix_micros("scraped_at"), F.lit(-62_135_596_800_000_000)) + F.lit(MICRO_SHIFT)
    ordered = micros.cast("decimal(18,0)") * F.lit(STATE_SPAN).cast("decimal(19,0)") + state_code(F.col("price"), F.col("available")).cast("decimal(18,0)")
    keyed = snapshots.where("snapshot_id IS NOT NULL AND url IS NOT NULL").select("snapshot_id", plain_url(F.col("url")).alias("url"), ordered.cast("decimal(38,0)").alias("_ordered"))
    newest = keyed.groupBy("snapshot_id", "url").agg(F.max("_ordered").alias("_newest"))
    return newest.select("snapshot_id", "url", F.pmod("_newest", F.lit(STATE_SPAN).cast("decimal(19,0)")).cast("bigint").alias("state"))


def snapshot_changes(snapshots: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, url, change) for each pair of consecutive snapshots.

    snapshots: snapshot_id, url, price, available, scraped_at; other columns are ignored. runs: the known
    snapshot_ids; a run that delivered no row still ends and begins a pair. Without it the ids that occur count.
    Null keys are left out, ties and repeats are settled by :func:`latest_states`, an empty input gives no rows.
    """
    ids = (snapshots if runs is None else runs).select("snapshot_id").where("snapshot_id IS NOT NULL").distinct()
    # one row per delivery, so the unpartitioned window holds as many rows as there are snapshots
    order = Window.orderBy("snapshot_id")
    chain = ids.select("snapshot_id", F.lag("snapshot_id").over(order).alias("_before"), F.lead("snapshot_id").over(order).alias("_after"))
    states = latest_states(snapshots).join(small_side(chain), "snapshot_id")
    sides = F.array(
        F.when(F.col("_before").isNotNull(), F.struct(F.col("snapshot_id").alias("pair"), F.lit(1).alias("side"))),
        F.when(F.col("_after").isNotNull(), F.struct(F.col("_after").alias("pair"), F.lit(-1).alias("side"))),
    )
    both = states.repartition("url").select("url", "state", F.explode(sides).alias("s")).where("s IS NOT NULL").select("url", "state", "s.pair", "s.side")
    residue = both.groupBy("url", "pair", "state").agg(F.sum("side").alias("left_over")).where("left_over <> 0")
    joined = residue.groupBy("url", "pair").agg(F.max(F.col("left_over") > 0).alias("_new"), F.max(F.col("left_over") < 0).alias("_old"))
    change = F.when(F.col("_new") & F.col("_old"), "changed").when(F.col("_new"), "added").otherwise("removed")
    return joined.select(F.col("pair").cast("int").alias("snapshot_id"), "url", change.alias("change"))
