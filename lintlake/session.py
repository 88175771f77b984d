"""Session helpers: a local session for tests, the shared folder, input spreading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "lintlake", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A local session without that setting uses the
    warehouse; a cluster without it is an error, as its executors might not share that folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, for tables one job writes and another reads."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both and broadcasts neither.

    Spark takes rows that an explode or a Python function makes for as few as those they are made of, and would
    send millions of them through the driver.
    """
    return df.hint("merge")


SMALL_SCAN = 8  # partitions: at most a gigabyte with the default split size


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a small scan over the session's cores.

    A file with one row group gives one task however many cores wait. Only scans
    of at most ``SMALL_SCAN`` partitions are shuffled, so the shuffle is bounded;
    every larger input passes through as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df.rdd.getNumPartitions()
    if partitions > SMALL_SCAN or partitions >= cores:
        return df
    return df.repartition(cores, *keys)
