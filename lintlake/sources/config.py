"""Guidance maps, prompt catalogues, response chunks and device snapshots as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import telemetry


def guidance_map(documents: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """JSON objects to ``keys, pos, needle, guidance``; anything but an object is an error."""
    parsed = F.from_json(F.col(column), schemas.GUIDANCE_MAP)
    is_object = F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("OBJECT")
    checked = F.when(is_object, F.map_entries(parsed)).otherwise(
        F.raise_error(F.lit("the substitution guidance is not a JSON object")).cast(
            "array<struct<key:string,value:string>>"
        )
    )
    rows = documents.select(*keys, F.posexplode(checked).alias("pos", "e"))
    return rows.select(*keys, "pos", F.col("e.key").alias("needle"), F.col("e.value").alias("guidance"))


def read_guidance_map(spark: SparkSession, path: str) -> DataFrame:
    return guidance_map(spark.read.text(path, wholetext=True), "value")


def prompt_catalogue(rows: DataFrame, *pos: str) -> DataFrame:
    """One content per role; the last row of a role wins."""
    order = F.struct(*pos) if len(pos) > 1 else F.col(pos[0])
    return rows.groupBy("role").agg(F.max_by("content", order).alias("content"))


def chunk_content(chunk: Column) -> Column:
    """Text of one streamed response chunk; empty when the chunk carries none."""
    parsed = F.from_json(chunk, schemas.RESPONSE_CHUNK)
    return F.coalesce(F.get(parsed["choices"], F.lit(0))["delta"]["content"], F.lit(""))


def response_chunks(chunks: DataFrame, column: str = "chunk") -> DataFrame:
    return chunks.withColumn("content", chunk_content(F.col(column))).drop(column)


def device_snapshots(snapshots: DataFrame, column: str = "snapshot", board: str | None = None) -> DataFrame:
    """Snapshot text to one column per field; the other columns stay.

    Patterns run in a projection of their own: a field may use a capture several times.
    """
    keep = [c for c in snapshots.columns if c not in (column, board)]
    found = telemetry.captures(F.col(column), F.col(board) if board else None)
    captured = snapshots.select(*keep, *[c.alias(name) for name, c in found.items()])
    return captured.select(*keep, *[c.alias(name) for name, c in telemetry.fields().items()])


def read_device_snapshots(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("ts"),
        F.col("value").alias("snapshot"),
    )
    return device_snapshots(raw)
