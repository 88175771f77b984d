"""Source files as rows: whole text, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as tx


def is_python_path(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))


def select_python_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path ends with ``.py``, case-sensitive."""
    return files.filter(is_python_path(F.col(path)))


def corpus_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every ``.py`` file below ``root``: ``path, name, ext, text``.

    A file that is not valid UTF-8 is left out, as an unreadable file would be.
    Spark's file sources list no files of zero bytes, so an empty file gives no row.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.py")
        .load(root)
        .select("path", "content")
    )
    return as_files(raw.filter(F.is_valid_utf8(F.col("content").cast("string"))))


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """The paths :func:`corpus_scan` leaves out, for the log."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.py")
        .load(root)
        .select("path", "content")
    )
    return raw.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path")


def as_files(raw: DataFrame) -> DataFrame:
    path = F.col("path")
    return raw.select(
        "path",
        tx.base_name(path).alias("name"),
        tx.extension(path).alias("ext"),
        F.col("content").cast("string").alias("text"),
    )
