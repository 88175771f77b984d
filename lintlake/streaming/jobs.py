"""Incremental forms of the batch jobs, on Structured Streaming.

Stateful results go to an upsert log: every micro-batch writes the rows it
changed under its own batch folder (rewriting it on a retry changes nothing),
and a reader takes the newest row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators.device import device_windows
from lintlake.operators.paging import dense_text_pages
from lintlake.operators.rules import LineRule, scan_verdicts
from lintlake.session import shared_path
from lintlake.sources.config import device_snapshots, response_chunks

BATCH = "batch_id"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stateless results to Parquet, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def upsert_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Changed rows of each micro-batch to the upsert log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest version per key of an upsert log."""
    logged = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    values = [n for n in schema.names if n not in keys]
    newest = F.max_by(F.struct(*values), F.col(BATCH)).alias("_v")
    return spark.read.schema(logged).parquet(path).groupBy(*keys).agg(newest).select(*keys, "_v.*")


def upserted(stream: DataFrame, keys: Sequence[str], purpose: str) -> DataFrame:
    """Run a stateful stream over what is there now and read its result."""
    spark = stream.sparkSession
    root = shared_path(spark, purpose)
    upsert_to(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return latest(spark, f"{root}/log", stream.schema, keys)


def reassembled(chunks: DataFrame) -> DataFrame:
    """``request_id, page, text``: chunk contents joined in ``seq`` order, in whatever order they arrive."""
    return dense_text_pages(response_chunks(chunks), ["request_id"], "seq", "content", "", "text")


def reassembled_stream(chunks: DataFrame, created: str = "created", lateness: str = "1 day") -> DataFrame:
    """As :func:`reassembled` over a stream, in update mode: each batch gives the text so far.

    ``created`` is the time a response began, which all its chunks carry. It
    puts a response in one window, so the watermark can drop responses that
    began longer than ``lateness`` ago from the state.
    """
    timed = response_chunks(chunks.withWatermark(created, lateness)).withColumn("began", F.window(created, "1 hour"))
    return dense_text_pages(timed, ["request_id", "began"], "seq", "content", "", "text").drop("began")


def monitored_devices(snapshots: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed device statistics over a stream of snapshots, late ones up to ``lateness`` included."""
    return device_windows(device_snapshots(snapshots.withWatermark("ts", lateness)), width)


def scanned_stream(files: DataFrame, rules: Sequence[LineRule], keys: Sequence[str], text: str = "text") -> DataFrame:
    """Verdicts for files as they arrive; stateless."""
    return scan_verdicts(files, rules, keys, text)


def appended(stream: DataFrame, purpose: str, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream over what is there now and read its result.

    ``settings`` are in force while the stream starts, which fixes them for it; the session gets its own back.
    """
    spark = stream.sparkSession
    root = shared_path(spark, purpose)
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        append_to(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
