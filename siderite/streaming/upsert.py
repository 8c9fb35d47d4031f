"""Incremental merges: micro-batches of listings into a keyed table, and windows over a stream.

State lives in the table, not in the stream: a micro-batch replaces the keys it brings and the table is put in
place at once, under the batch's number, so that a batch which runs again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siderite.operators.merge import last_wins


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of the table below ``path``; empty before the first batch."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{path}/v{max(done)}") if done else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps, below ``path``, the row of highest ``seq`` for each key; versions but the last two are removed.

    Rows that come late lose to newer ones by ``seq``, not by arrival.
    """
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_table(spark, path, schema)
        merged = last_wins(old.unionByName(last_wins(batch, keys, seq)), keys, seq)
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")
        jvm = spark._jvm
        for n in range(max(0, number - 4), number - 1):
            stale = jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
            stale.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stale, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, moment: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, end, key, n, total): counts and sums by event time; rows later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn("_t", F.col(moment).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    out = timed.groupBy(window.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def sessions(stream: DataFrame, moment: str, key: str, gap: str, late: str) -> DataFrame:
    """(start, end, key, n): runs of events of a key with no gap as long as ``gap``."""
    timed = stream.withColumn("_t", F.col(moment).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.session_window("_t", gap).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
