"""Thousands of needles at once.

``rules`` turns every rule into an expression, so each line meets each rule. Here a needle stands under its rarest run of
``GRAM`` characters; the bytes of texts are searched for such runs, many texts at a time, and only texts and needles
that share a run are compared, exactly. Nothing is left out: a text that contains a needle contains
the run it stands under.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.operators.rules import LineRule

GRAM = 4  # characters of a run; a shorter needle is its own run
PIECE = 4096  # characters of a text that are searched at a time
MAP_BITS = 20  # of the map that tells most other runs apart
SEARCHED = 1 << 20  # bytes of texts that are searched at once
BROADCAST_BYTES = 16 << 20  # more rules than that are joined by a shuffle


def grams(needle: str) -> list[str]:
    """The runs of a needle, repeats included."""
    return [needle[i : i + GRAM] for i in range(max(1, len(needle) - GRAM + 1))]


def anchors(needles: Collection[str], counts: Mapping[str, int] | None = None) -> dict[str, str]:
    """The run each needle stands under: the one ``counts`` has least of, then the one in the fewest needles.

    ``counts`` are those of a corpus (:func:`gram_counts`); without them only the needles decide. The choice changes
    the work, never the rows.
    """
    held = Counter(g for needle in set(needles) for g in set(grams(needle)))
    counts = counts or {}
    return {needle: min(grams(needle), key=lambda g: (counts.get(g, 0), held[g], g)) for needle in needles}


def _numbers(data: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A number for each run of ``length`` bytes of ``data``."""
    out = np.zeros(max(0, len(data) - length + 1), np.uint64)
    for i in range(length):
        out = out * np.uint64(factor) + data[i : i + len(out)]
    return out


def _finder(known: Collection[str]) -> Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, int]]]:
    """What finds runs of ``known`` in bytes: their places and which they are (by place in ``known``), length by length."""
    runs = [np.frombuffer(gram.encode(), np.uint8) for gram in known]
    tables = []
    for length in sorted({len(run) for run in runs}):
        own = np.array([i for i, run in enumerate(runs) if len(run) == length])
        data = np.concatenate([runs[i] for i in own])
        for factor in range(257, 1 << 16, 2):  # the first one that tells all runs apart
            numbers = _numbers(data, length, factor)[::length]
            if len(np.unique(numbers)) == len(numbers):
                break
        else:
            raise ValueError(f"runs of {length} bytes that no factor tells apart")
        order = np.argsort(numbers)
        marked = np.zeros(1 << MAP_BITS, bool)
        marked[_place(numbers)] = True
        tables.append((length, factor, numbers[order], own[order], marked))

    def find(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for length, factor, numbers, own, marked in tables:
            all_numbers = _numbers(data, length, factor)
            at = np.flatnonzero(marked[_place(all_numbers)])
            number = all_numbers[at]
            spot = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
            same = numbers[spot] == number
            yield at[same], own[spot[same]], length

    return find


def _place(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _text_grams(units: DataFrame, unit: str, known: Collection[str], reach: int) -> DataFrame:
    """``units`` once per piece and run of ``known`` in it, as ``_piece`` and ``_gram``.

    A piece reaches ``reach`` characters into the next one, so a needle lies within one piece.
    """
    width = max(PIECE, reach)
    blocks = units.withColumn("_blocks", F.regexp_extract_all(unit, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))
    pieces = F.transform(
        "_blocks", lambda block, i: F.concat(block, F.substring(F.coalesce(F.get("_blocks", i + 1), F.lit("")), 1, reach))
    )
    cut = blocks.select(*units.columns, F.explode(pieces).alias("_piece"))
    names = sorted(known)
    find = _finder(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pa.array(names, pa.string())
        for batch in batches:
            texts = batch.column("_piece").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SEARCHED, "right")) - 1)
                found = []
                for at, gram, length in find(raw[ends[first] : ends[last]]):
                    at = at + ends[first]
                    text = np.searchsorted(ends, at, "right") - 1
                    inside = at + length <= ends[text + 1]
                    found.append(text[inside] * len(names) + gram[inside])
                pairs = np.unique(np.concatenate(found))
                rows = batch.take(pa.array(pairs // len(names)))
                yield pa.RecordBatch.from_arrays([*rows.columns, grams.take(pa.array(pairs % len(names)))], names=[*batch.schema.names, "_gram"])
                first = last

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField("_gram", T.StringType())]))


def _bounded(rows: DataFrame, size: int) -> DataFrame:
    """Broadcast rows made of ``size`` bytes of plain values when that is little."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def gram_counts(files: DataFrame, needles: Collection[str], text: str = "text") -> DataFrame:
    """``gram, n``: in how many pieces of the texts each run of the needles occurs; runs that never occur have no row.

    At most one row per run of a needle, to be collected and given to :func:`anchors`.
    """
    known = sorted({g for needle in needles if needle for g in grams(needle)})
    if not known:
        return files.sparkSession.createDataFrame([], "gram string, n bigint")
    runs = _text_grams(files.select(F.col(text).alias("_unit")), "_unit", known, GRAM - 1).select("_gram")
    own = files.sparkSession.createDataFrame([(g,) for g in known], "gram string")
    counted = runs.groupBy(F.col("_gram").alias("gram")).agg(F.count("*").alias("n"))
    return counted.join(_bounded(own, sum(len(g.encode()) + 16 for g in known)), "gram", "left_semi")


def _candidates(
    units: DataFrame, unit: str, rows: Sequence[tuple], columns: str, counts: Mapping[str, int] | None
) -> DataFrame:
    """``units`` with the ``rows`` whose needle (first value) they contain; a row may come once per piece."""
    under = anchors([row[0] for row in rows], counts)
    known = set(under.values())
    table = units.sparkSession.createDataFrame(
        [(under[row[0]], *row) for row in rows], f"_gram string, _needle string, {columns}"
    )
    size = sum(64 + sum(len(str(value).encode()) for value in row) for row in rows)
    runs = _text_grams(units, unit, known, max(len(row[0]) for row in rows) - 1)
    return runs.join(_bounded(table, size), "_gram").where(F.contains("_piece", "_needle"))


def scan_many_rules(
    files: DataFrame,
    rules: Sequence[LineRule],
    keys: Sequence[str],
    text: str = "text",
    counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """``keys, pos, line_number, variable_name, reason``: the rows of ``rules.scan_lines``, for thousands of rules.

    Every rule needs a needle. ``keys`` identify a file; files without a text have no hits. Only hits are shuffled.
    """
    bare = [rule.variable_name for rule in rules if not rule.needle]
    if bare:
        raise ValueError(f"rules without a needle: {bare[:5]}")
    of_keys = F.struct(*keys).alias("_keys")
    if not rules:
        empty = [("pos", "int"), ("line_number", "int"), ("variable_name", "string"), ("reason", "string")]
        return files.where(F.lit(False)).select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in empty])
    lines = files.select(of_keys, F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    rows = [(r.needle, i, r.pattern, r.variable_name, r.reason) for i, r in enumerate(rules)]
    columns = "_rule int, _pattern string, variable_name string, reason string"
    found = _candidates(lines, "_line", rows, columns, counts).where(F.rlike("_line", F.col("_pattern")))
    hit = F.struct((F.col("_at") + 1).alias("line_number"), "_rule", "variable_name", "reason")
    ordered = found.groupBy("_keys").agg(F.sort_array(F.collect_set(hit)).alias("_hits"))
    hits = ordered.select("_keys", F.posexplode("_hits").alias("pos", "_hit"))
    return hits.select("_keys.*", "pos", "_hit.line_number", "_hit.variable_name", "_hit.reason")


def match_many(
    files: DataFrame,
    guidance: Mapping[str, str],
    keys: Sequence[str],
    code: str = "code",
    counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """``keys, pos, needle, advice``: the entries of ``guidance`` whose needle occurs in a file, in map order.

    The matches of ``rules.matched_guidance`` as rows, for thousands of entries; a file without matches has no row. The
    empty needle occurs in every file that has a text.
    """
    units = files.select(F.struct(*keys).alias("_keys"), F.col(code).alias("_unit"))
    entries = list(guidance.items())
    rows = [(needle, i, advice) for i, (needle, advice) in enumerate(entries) if needle]
    match = F.struct("_entry", F.col("_needle").alias("needle"), "advice")
    matches = [
        units.where(F.col("_unit").isNotNull()).select(
            "_keys", F.struct(F.lit(i).alias("_entry"), F.lit("").alias("needle"), F.lit(advice).alias("advice")).alias("_m")
        )
        for i, (needle, advice) in enumerate(entries)
        if not needle
    ]
    if rows:
        found = _candidates(units, "_unit", rows, "_entry int, advice string", counts)
        matches.append(found.select("_keys", match.alias("_m")))
    if not matches:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("needle", "string"), ("advice", "string"))]
        return files.where(F.lit(False)).select(*keys, *nothing)
    together = matches[0] if len(matches) == 1 else matches[0].unionByName(matches[1])
    ordered = together.groupBy("_keys").agg(F.sort_array(F.collect_set("_m")).alias("_all"))
    placed = ordered.select("_keys", F.posexplode("_all").alias("pos", "_m"))
    return placed.select("_keys.*", "pos", "_m.needle", "_m.advice")
