"""Session helpers: a local session for tests and one place that knows where checkpoints go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_stored: list[str] = []


def local_session(app: str = "siderite", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only where none is named (tests) make an own one."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siderite-checkpoints-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the checkpoint folder and read back: computed once, safe from lost executors.

    Unlike a checkpoint it runs df once and is read by column. The files go when the session ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most ``most_rows`` rows, else as it is; the count stops at the bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def release_stored(spark: SparkSession) -> int:
    """Deletes what :func:`stored` has written so far, for sessions that run long; results that rest on it must be saved before."""
    count = len(_stored)
    while _stored:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    return count
