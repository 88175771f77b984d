"""Small helpers shared by the operators: tables, Arrow texts, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space; everything else is part of a word
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share, so that what a job writes
    there outlives a lost executor. A local session without that setting uses the warehouse; a cluster without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (or bytes) in column ``at`` hold about ``most`` bytes together; a longer one comes alone."""
    for batch in batches:
        _, ends = text_bytes(batch.column(at))
        for i, j in groups_of(ends, most):
            yield batch.slice(i, j - i)


def mapped(df: DataFrame, names: list[str], run, schema) -> DataFrame:
    """``df.select(*names).mapInArrow(run, schema)`` for names of any kind; ``run`` finds the columns by place."""
    return df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` has no column of, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage. Without ``codec`` the session's packs the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """As :func:`written`, for texts: zstd takes about two thirds of the disk that snappy does."""
    return written(df, name, "zstd")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; a null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null(b"" if pa.types.is_binary(array.type) else "").cast(pa.large_binary())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def groups_of(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[i, j)`` of texts with at most ``most`` bytes together; a longer text comes alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
