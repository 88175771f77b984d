"""Exact repeats of fixed-width windows, found through stretches of windows instead of single ones.

A window is ``width`` consecutive items (words or bytes) of one text. Each window is named after its
anchor: the ``k``-item substring of least hash inside it (the leftmost one on ties). The anchor
depends on the window's items alone, so equal windows have equal anchors at equal offsets. The
consecutive windows of a text that share an anchor form a *stretch*; about ``(width - k) / 2``
windows make one, and texts are cut into stretches without looking at any other text.

* Two stretches of the same content (same ``cls``) repeat each other wholly: one comparison settles
  all their windows.
* Where one anchor (``key``) has stretches of different content, the paths branch; only there
  stretches are expanded into single windows, one representative for each content.

Rows name a text by ``did`` (its id, the least long for null) and ``t`` (a 64-bit hash of the text).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import groups_of, small_batches, text_bytes, written
from lintlake.llm.hashing import BYTE_VALUES, Rolling, mix, word_spans, words_of

_CHUNK = 1 << 18  # items that are hashed at once
_LOW = np.uint64(_CHUNK - 1)
NULL_ID = -(1 << 63)
STRETCH = "did long, t long, start int, n int, key long, cls long, cnt int"
MEMBER = ("did", "t", "start")


@dataclass(frozen=True)
class Windows:
    """How texts are cut: into words or bytes, window width, anchor width and items hashed at once."""

    words: bool
    width: int
    k: int
    chunk: int = field(default_factory=lambda: _CHUNK)

    def values(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item hashes of consecutive texts and the n + 1 item offsets."""
        if self.words:
            _, _, hashes, offsets = words_of(raw, ends)
            return hashes, offsets
        return BYTE_VALUES[raw], ends


def with_identity(documents: DataFrame) -> DataFrame:
    """(doc_id, text, did, t) of every document."""
    return documents.select(
        "doc_id", "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64("text").alias("t"),
    )


def _cut(values: np.ndarray, offsets: np.ndarray, how: Windows, raw: np.ndarray | None) -> list[np.ndarray]:
    """Stretches of at most ``how.chunk`` items: text number, start in the text, windows, key, cls."""
    n, width, k = len(values), how.width, how.k
    none = np.zeros(0, np.int64)
    if n < width:
        return [none] * 5
    rolling = Rolling(values)
    grams = rolling.windows(k)
    cur = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span, wide, windows = 1, width - k + 1, n - width + 1
    while span * 2 <= wide:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    cur = np.minimum(cur[:windows], cur[wide - span : wide - span + windows])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    at = np.flatnonzero(np.arange(windows) + width <= ends)
    if not len(at):
        return [none] * 5
    anchors = (cur[at] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    start, anchor = at[first], anchors[first]
    count = np.diff(np.append(first, len(at)))
    text = np.searchsorted(offsets, start, "right") - 1
    key = grams[anchor]
    if raw is not None:  # in suffix order: the first four bytes, then a hash of the anchor
        head = np.zeros(len(anchor), np.uint64)
        for i in range(4):
            head = (head << np.uint64(8)) | raw[anchor + i].astype(np.uint64)
        key = (head << np.uint64(32)) | (key >> np.uint64(32))
    with np.errstate(over="ignore"):
        salt = (anchor - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)
    cls = mix(rolling.of(start, start + count + width - 1) ^ mix(salt))
    return [text, start - offsets[text], count, key.view(np.int64), cls.view(np.int64)]


def _pieces(values: np.ndarray, offsets: np.ndarray, how: Windows):
    """Item ranges of at most ``how.chunk`` items; a longer text is cut so that ranges overlap by
    ``width - 1`` items and each window lies in one range only."""
    for i, j in groups_of(offsets, how.chunk):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= how.chunk:
            yield i, 0, lo, hi, offsets[i : j + 1] - lo
            continue
        for at in range(lo, max(lo + 1, hi - how.width + 1), how.chunk - how.width + 1):
            stop = min(hi, at + how.chunk)
            yield i, at - lo, at, stop, np.array([0, stop - at])


def stretches(docs: DataFrame, how: Windows) -> DataFrame:
    """All stretches of all texts (did, t, start, n, key, cls, cnt), a narrow step.

    Equal stretches of one batch of about 8 MB of text are settled at once: the earliest goes on with their number,
    the others get ``cnt`` 0 and a key of their own, so a very common passage is reduced before
    anything is shuffled. Copies of one and the same row merge.
    """

    def run(batches):
        for batch in small_batches(batches, 0, 1 << 23):
            raw, ends = text_bytes(batch.column(0))
            did = batch.column(1).to_numpy(zero_copy_only=False)
            t = batch.column(2).to_numpy(zero_copy_only=False)
            found = []
            for i, j in groups_of(ends, _CHUNK):
                part = raw[ends[i] : ends[j]]
                values, offsets = how.values(part, ends[i : j + 1] - ends[i])
                for text, shift, lo, hi, inner in _pieces(values, offsets, how):
                    own = _cut(values[lo:hi], inner, how, None if how.words else part[lo:hi])
                    own[0] = own[0] + (i + text)
                    own[1] = own[1] + shift
                    found.append(own)
            if not found:
                continue
            text, start, n, key, cls = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(text):
                continue
            d, h = did[text], t[text]
            order = np.lexsort((start, h, d, cls, key))
            text, start, n, key, cls, d, h = (x[order] for x in (text, start, n, key, cls, d, h))
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            at = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            cnt = np.where(fresh, np.diff(np.append(at, len(key)))[group], 0).astype(np.int32)
            lead = at[group]
            same = ~fresh & (d == d[lead]) & (h == h[lead]) & (start == start[lead])
            settled = ~fresh & ~same
            with np.errstate(over="ignore"):
                key = np.where(settled, mix(d.astype(np.uint64) ^ (start.astype(np.uint64) << np.uint64(40))).view(np.int64), key)
            keep = ~same
            cols = (d, h, start.astype(np.int32), n.astype(np.int32), key, cls, cnt)
            for a in range(0, int(keep.sum()), 1 << 17):
                cut = np.flatnonzero(keep)[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in cols], names=names)

    names = [f.split()[0] for f in STRETCH.split(", ")]
    return docs.select("text", "did", "t").mapInArrow(run, STRETCH)


def compare(rows: DataFrame) -> DataFrame:
    """Add to stretches what the others of their key say: ``c`` copies of the same content, ``rank``
    of the row among them by (did, t, start), and ``branches``: the key has other contents too.

    One shuffle by key and one sort serve all three windows.
    """
    by_key = Window.partitionBy("key")
    by_cls = Window.partitionBy("key", "cls")
    ordered = by_cls.orderBy(*MEMBER)
    return rows.select(
        "*",
        F.rank().over(ordered).alias("rank"),
        F.sum("cnt").over(by_cls).alias("c"),
        (F.min("cls").over(by_key) != F.max("cls").over(by_key)).alias("branches"),
    )


def sieve(keys: DataFrame, bits: int = 24):
    """A bit map of ``2**bits`` bits (2 MB) over the ``did`` values of ``keys``, for every size of input.

    It only saves work: a text whose bit is unset surely has no row in ``keys``.
    """
    bit = F.pmod(F.xxhash64("did"), F.lit(1 << bits))
    parts = (
        keys.select((bit + 1).alias("bit"))  # buckets and positions count from 1
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():  # at most 2**bits / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["map"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out), bit


def sifted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may have rows in ``keys``, and those that surely have none."""
    shared, bit = sieve(keys)
    columns = docs.columns
    flagged = docs.withColumn("_bit", bit)

    def run(keep):
        def inner(batches):
            for batch in batches:
                at = batch.column(len(columns)).to_numpy(zero_copy_only=False)
                pos, bucket = at % 32768, at // 32768
                hit = (shared.value[bucket * 4096 + pos // 8] >> (pos % 8).astype(np.uint8)) & 1
                yield batch.select(columns).filter(pa.array(hit.astype(bool) == keep))

        return inner

    schema = docs.schema
    return flagged.mapInArrow(run(True), schema), flagged.mapInArrow(run(False), schema)


HOT_KEY = 4_000  # open stretches of one key that a task may hold; keys beyond go window by window


def slices(docs: DataFrame, chosen: DataFrame, how: Windows) -> DataFrame:
    """The bytes behind the ``chosen`` stretches (did, t, start, n, key, single), each stretch once
    however often it was chosen: adds ``span``, the text from its first window to its last."""
    lists = chosen.groupBy("did", "t").agg(F.collect_set(F.struct("start", "n", "key", "single")).alias("parts"))
    some, _ = sifted(docs.select("text", "did", "t"), chosen)
    rows = some.join(lists, ["did", "t"]).select("text", "did", "t", "parts")

    def run(batches):
        for batch in small_batches(batches, 0):
            raw, ends = text_bytes(batch.column(0))
            lists = batch.column(3).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else batch.column(3)
            found, spans = [], []
            for r, (did, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = raw[ends[r] : ends[r + 1]]
                start, n, key, single = (p.to_numpy(zero_copy_only=False) for p in lists[r].values.flatten())
                last = start + n + how.width - 2
                if how.words:
                    begins, stops = word_spans(text)
                    lo, hi = begins[start], stops[last]
                else:
                    lo, hi = start, last + 1
                data = text.tobytes()
                spans += [data[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                found.append((np.full(len(n), did), np.full(len(n), t), start, n, key, single))
            if found:
                cols = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.binary())], names=names)

    names = ["did", "t", "start", "n", "key", "single", "span"]
    return rows.mapInArrow(run, "did long, t long, start int, n int, key long, single boolean, span binary")


def _windows(table: pa.Table, how: Windows) -> tuple[np.ndarray, ...]:
    """All windows of rows of ``slices``: row number, start and hash."""
    raw, ends = text_bytes(table.column("span"))
    start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
    row, at, hashes = [], [], []
    for i, j in groups_of(ends, _CHUNK):
        values, offsets = how.values(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        count = n[i:j].astype(np.int64)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row.append(np.repeat(np.arange(i, j), count))
        at.append(np.repeat(start[i:j], count) + inner)
        hashes.append(Rolling(values).windows(how.width)[np.repeat(offsets[:-1], count) + inner])
    return tuple(np.concatenate(x) for x in (row, at, hashes))


def _repeated(table: pa.Table, how: Windows, earlier: bool) -> pa.RecordBatch:
    """Runs of repeated windows among stretches that hold all rows of their keys."""
    row, at, hashes = _windows(table, how)
    did, t, key = (table.column(c).to_numpy()[row] for c in ("did", "t", "key"))
    order = np.lexsort((at, t, did, hashes, key)) if earlier else np.lexsort((hashes, key))
    row, at, hashes, did, t, key = (x[order] for x in (row, at, hashes, did, t, key))
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])])
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    if earlier:
        lead = first[group]
        bad = (did != did[lead]) | (t != t[lead]) | (at != at[lead])
    else:
        bad = (np.diff(np.append(first, len(key)))[group] > 1) & table.column("single").to_numpy()[row]
    did, t, at = did[bad], t[bad], at[bad]
    order = np.lexsort((at, t, did))
    did, t, at = did[order], t[order], at[order]
    begins = np.ones(len(at), bool)
    begins[1:] = (did[1:] != did[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + 1)
    begins = np.flatnonzero(begins)
    ends = np.append(begins[1:], len(at)) - 1
    n = (at[ends] - at[begins] + 1) if len(at) else at
    cols = (did[begins], t[begins], at[begins].astype(np.int32), n.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["did", "t", "start", "n"])


def _whole_keys(table: pa.Table, most: int = _CHUNK):
    """Parts of a table sorted by key of about ``most`` windows each; a key is in one part."""
    keys = table.column("key").to_numpy()
    begins = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
    windows = np.concatenate([[0], np.cumsum(table.column("n").to_numpy().astype(np.int64))])
    for i, j in groups_of(windows[begins], most):
        yield table.slice(int(begins[i]), int(begins[j] - begins[i]))


def repeated(docs: DataFrame, chosen: DataFrame, how: Windows, earlier: bool) -> DataFrame:
    """Runs (did, t, start, n) of windows of the ``chosen`` stretches that repeat a window of another:
    one that starts earlier, or any other if the stretch is ``single``.

    Stretches are dealt by key as plain bytes and opened where all stretches of a key are together.
    A key with more than ``HOT_KEY`` of them is opened before the shuffle instead, and its windows
    are dealt one by one, so that no task holds it whole.
    """
    hot = chosen.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_KEY).select("key", F.lit(True).alias("hot"))
    spans = written(slices(docs, chosen.join(hot, "key", "left_anti"), how), "spans")
    dealt = spans.repartition("key").sortWithinPartitions("key")

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            keys = kept.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # rows before the last key
            if whole:
                for part in _whole_keys(kept.slice(0, whole)):
                    yield _repeated(part, how, earlier)
                kept = kept.slice(whole).combine_chunks()
        if kept is not None and kept.num_rows:
            for part in _whole_keys(kept):
                yield _repeated(part, how, earlier)

    def opened(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                table = pa.Table.from_batches([batch.slice(begin, 1024)])
                row, at, hashes = _windows(table, how)
                cols = [table.column(c).to_numpy()[row] for c in ("did", "t", "key", "single")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, at.astype(np.int32), hashes.view(np.int64))], names=names)

    names = ["did", "t", "key", "single", "start", "hash"]
    most = slices(docs, chosen.join(hot, "key", "left_semi"), how).mapInArrow(opened, "did long, t long, key long, single boolean, start int, hash long")
    same = Window.partitionBy("key", "hash")
    if earlier:
        most = most.withColumn("rank", F.rank().over(same.orderBy(*MEMBER))).where("rank > 1")
    else:
        most = most.withColumn("copies", F.count("*").over(same)).where("copies > 1 AND single")
    return dealt.mapInArrow(run, "did long, t long, start int, n int").unionByName(most.select(*MEMBER, F.lit(1).alias("n")))


def covered(parts: list[dict] | None, n: int, width: int) -> np.ndarray:
    """Which of ``n`` items some flagged window covers; ``parts`` are (start, n windows)."""
    edge = np.zeros(n + 1, np.int32)
    for p in parts or ():
        edge[p["start"]] += 1
        edge[min(n, p["start"] + p["n"] + width - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def applied(docs: DataFrame, flags: DataFrame, make, schema: str) -> DataFrame:
    """Call ``make(doc_id, text bytes, parts, again)`` for each document; ``parts`` are its flagged
    (start, n). ``again`` tells that an equal row (same id and text) came before it.

    Only documents that may have flags are shuffled and joined.
    """
    lists = flags.groupBy("did", "t").agg(F.collect_set(F.struct("start", "n")).alias("parts"))
    some, rest = sifted(docs, flags)
    joined = some.join(lists, ["did", "t"], "left").select("did", "t", "doc_id", "text", "parts")
    ordered = joined.sortWithinPartitions("did", "t", "text")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        last = None
        for batch in small_batches(batches, 3):
            out = []
            for did, t, doc, raw, parts in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4), strict=True):
                text = (raw.as_py() or "").encode()
                again = last == (did, t, text)
                last = (did, t, text)
                out.append(make(doc, text, parts.as_py(), again))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], k) for k in types], names=names)

    def plain(batches):
        for batch in small_batches(batches, 1):
            out = [make(doc, (raw.as_py() or "").encode(), None, False) for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], k) for k in types], names=names)

    return ordered.mapInArrow(run, schema).unionByName(rest.select("doc_id", "text").mapInArrow(plain, schema))
