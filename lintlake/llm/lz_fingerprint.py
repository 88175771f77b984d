"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into dictionary phrases: each phrase is the longest one known plus
one code point, and joins the dictionary. The set of phrase hashes is summed up by minimum hashes,
so two texts that would compress well with each other's dictionary share many of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import mapped
from lintlake.llm.hashing import Rolling, mix

HASHES = 64
EMPTY = "ffff" * HASHES  # no phrase at all
_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def parse(text: str, known: set[str], start: int, cuts: list[int]) -> None:
    """Go on parsing ``text`` at ``start``; phrases join ``known`` and their ends ``cuts``.

    The dictionary holds every prefix of its phrases, so the longest known phrase is found by
    stepping up or down from a guess. A rest that is already known is a phrase of its own.
    """
    n, guess = len(text), 4
    while start < n:
        end = start + guess
        if end < n and text[start:end] in known:
            end += 1
            while end < n and text[start:end] in known:
                end += 1
        else:
            end = min(end, n)
            while end - 1 > start and text[start : end - 1] not in known:
                end -= 1
        known.add(text[start:end])
        cuts.append(end)
        guess = max(1, end - start - 1)
        start = end


def signature(text: str, cuts: list[int]) -> np.ndarray:
    """The minimum of each hash function over the phrases that end at ``cuts``."""
    if not cuts:
        return np.full(HASHES, 0xFFFF, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.array(cuts)
    starts = np.concatenate([[0], ends[:-1]])
    phrases = Rolling(mix(points.astype(np.uint64) + np.uint64(1))).of(starts, ends)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(phrases), 4096):
            x = phrases[at : at + 4096, None] * _SALTS[None, :]
            np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(text: str, edited_tail: str | None = None, keep: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The signature of ``text`` and, if given, of ``text[:keep] + edited_tail``, parsing the common
    head once up to the last phrase inside it."""
    known: set[str] = set()
    cuts: list[int] = []
    parse(text, known, 0, cuts)
    own = signature(text, cuts)
    if edited_tail is None:
        return own, None
    # phrases that end before ``keep`` were found without looking at what follows
    common = int(np.searchsorted(np.array(cuts, dtype=np.int64), keep, "left"))
    begin = cuts[common - 1] if common else 0
    start = 0
    head: set[str] = set()
    for end in cuts[:common]:
        head.add(text[start:end])
        start = end
    edited, cuts = text[:keep] + edited_tail, cuts[:common]
    parse(edited, head, begin, cuts)
    return own, signature(edited, cuts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text: 64 minimum hashes of 16 bits as 256 hex digits.

    A narrow step. Null and empty texts have no phrase and get ``ffff`` 64 times; equal texts have
    equal fingerprints; a column already named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c != out]
    at = keep.index(text)

    def run(batches):
        for batch in batches:
            got = [to_hex(fingerprints(x.as_py() or "")[0]) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])
    return mapped(df, keep, run, schema)


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    """Upper bounds of at most ``parts`` id ranges of about equal size (a fixed number of longs)."""
    shares = [i / parts for i in range(1, parts)]
    cuts = ids.approxQuantile("doc_id", shares, 0.2 / parts) if shares else []
    return sorted({int(c) for c in cuts})


def edited_pairs(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every document, its edited text and the next document, in one text shuffle.

    The next document is the one before it in ascending ``doc_id`` (rows of one id follow each other
    by their text; the first goes on with the last; null ids come last of all). The edited text
    swaps the last ``n // 3`` code points for the first ``n // 3`` of the next document.

    Documents are dealt into id ranges; the last row of each range is also sent to the range that
    needs it as its "next", so no window over all rows is needed. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An empty table gives no
    rows; a single document is its own next.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * partitions  # several to a task, so that tasks are even
    docs = documents.select("doc_id", "text")
    bounds = _ranges(docs.where("doc_id IS NOT NULL"), parts)
    cut = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    # range 0 holds the nulls, then come the ids in ascending order
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + F.size(F.filter(cut, lambda b: b < F.col("doc_id")))).cast("int")
    dealt = docs.withColumn("part", part)
    last = dealt.groupBy("part").agg(F.max("doc_id").alias("id")).orderBy("part").collect()
    # at most ``parts`` + 1 rows: the end of each range is the next of the range after it
    wanted = [(last[i - 1]["part"], last[i - 1]["id"], r["part"]) for i, r in enumerate(last)]
    guests = F.broadcast(spark.createDataFrame(wanted, "part int, end long, target int"))
    both = F.array(F.struct(F.col("part").alias("to"), F.lit(1).alias("own")), F.struct(F.col("target").alias("to"), F.lit(0).alias("own")))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("end")), both).otherwise(F.slice(both, 1, 1))
    sent = dealt.join(guests, "part").select("doc_id", "text", F.inline(copies))
    # guests sort before the range's own rows; among several guests of one id the last text counts
    rows = sent.repartition(partitions, "to").sortWithinPartitions("to", "own", F.col("doc_id").asc_nulls_first(), "text")
    ids = rows.select("to", "own", "doc_id", "text")

    def run(batches):
        import hashlib

        part, nxt, nxt_sig = None, "", None
        for batch in batches:
            cols = {k: [] for k in ("doc_id", "n", "sha", "f", "e", "ne", "nn")}
            for to_, own, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                text = raw.as_py() or ""
                if to_ != part:
                    part, nxt, nxt_sig = to_, "", None
                if not own:
                    nxt, nxt_sig = text, None
                    continue
                n = len(text)
                third = n // 3
                tail = nxt[:third]
                sig, edited = fingerprints(text, tail, n - third)
                if nxt_sig is None:
                    nxt_sig = fingerprints(nxt)[0]
                cols["doc_id"].append(doc)
                cols["n"].append(n)
                cols["sha"].append(hashlib.sha256((text[: n - third] + tail).encode()).hexdigest())
                cols["f"].append(to_hex(sig))
                cols["e"].append(to_hex(edited))
                cols["ne"].append(likeness(sig, edited))
                cols["nn"].append(likeness(sig, nxt_sig))
                nxt, nxt_sig = text, sig
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return ids.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
