"""Byte-level BPE: encode whole texts with a local rank file, decode ids to the raw bytes.

``encode`` and ``decode`` are one narrow step each (no shuffle). A long text is cut into pieces at
places where no match of the splitting pattern can cross, so the ids equal those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lintlake.llm.common import mapped, small_batches

PIECE_CHARS = 1 << 15
# Between an ASCII letter or digit and a blank every match ends; so between a letter and a digit.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut at the first safe boundary after each ``size`` characters; a text without one stays whole."""
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def load(ranks_path: str, pattern: str):
    """The tokenizer of a rank file (base64 token, blank, rank on each line), without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give empty ids. Bytes that are not UTF-8 count as U+FFFD. All rows and
    other columns stay; a column already named ``ids`` is replaced.
    ``ranks_path`` must exist on every executor.
    """
    keep = [c for c in df.columns if c != ids]
    at = keep.index(text)

    def run(batches):
        tokenizer = load(ranks_path, pattern)
        for batch in small_batches(batches, at):
            out = [
                b"".join(np.array(tokenizer.encode_ordinary(p), "<u4").tobytes() for p in pieces(value))
                if (value := raw.as_py()) else b""
                for raw in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, ids])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.BinaryType())])
    return mapped(df, keep, run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids stand for; null ids give empty bytes."""
    keep = [c for c in df.columns if c != out]
    at = keep.index(ids)

    def run(batches):
        tokenizer = load(ranks_path, pattern)
        for batch in small_batches(batches, at):
            got = [tokenizer.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])
    return mapped(df, keep, run, schema)
