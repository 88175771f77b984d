"""Substring dedup over bytes with a logarithmic family of levels of hashed anchors.

Hashed anchors take the place of suffix arrays, which are not built here: a batch of documents gives a
table of its anchors (at least one in every ``width`` bytes, see ``repeats``) and the stretches of
windows they name. A new batch is compared with the levels that exist in one shuffle by anchor, which
finds stretches of ``width`` bytes or more that both hold. Levels of equal size merge in the same shuffle,
so sizes grow geometrically and there are at most log2(batches) + 1 levels beside the newest.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import repeats
from lintlake.llm.common import written

WIDTH = 200
K = 32
BATCHES = 4
_ENTRY = ("did", "t", "start", "n", "key", "cls", "cnt")
_RESTING, _MERGING, _FRESH = 0, 1, 2  # what becomes of a row of a scan: its level stays, merges, or is a new one


@dataclass
class SuffixIndex:
    """Levels of (number of batches, entries); an entry is the first stretch of its content in a level,
    with the number of copies (2 for more)."""

    how: repeats.Windows
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)

    def compact(self, fresh: DataFrame | None = None) -> DataFrame | None:
        """Merge the last levels while they are of equal size, and scan the stretches of a ``fresh`` batch
        beside all levels in the same shuffle; the batch becomes a level of its own."""
        at = len(self.levels) - 1
        size = self.levels[at][0] if self.levels else 0
        while at > 0 and self.levels[at - 1][0] == size:
            at, size = at - 1, 2 * size
        merging = at < len(self.levels) - 1
        at = at if merging else len(self.levels)
        parts = [level.withColumn("part", F.lit(_MERGING if i >= at else _RESTING)) for i, (_, level) in enumerate(self.levels)]
        parts = parts[at:] if fresh is None else [*parts, fresh.withColumn("part", F.lit(_FRESH))]
        if not parts:
            return None
        scan = repeats.compare(reduce(DataFrame.unionByName, parts))
        same = Window.partitionBy("key", "cls")
        own = same.orderBy(*repeats.MEMBER).rowsBetween(Window.unboundedPreceding, 0)  # the scan's own order
        copies, nth = F.lit(0), F.lit(0)
        for part in (_MERGING, _FRESH):
            here = F.col("part") == part
            copies = F.when(here, F.sum(F.when(here, F.col("cnt"))).over(same)).otherwise(copies)
            nth = F.when(here, F.sum(here.cast("int")).over(own)).otherwise(nth)
        # what rows of one key say about each other is said once, in the scan that its newest row comes with
        news = F.bool_or(F.col("part") == _FRESH).over(Window.partitionBy("key"))
        scan = scan.withColumns({"copies": copies, "nth": nth, "news": news})
        scan = scan.select(
            *_ENTRY,
            "part",
            (F.col("news") & ((F.col("cnt") == 0) | (F.col("c") > 1))).alias("flag"),
            (F.col("news") & (F.col("cnt") > 0) & (F.col("rank") == 1) & F.col("branches")).alias("open"),
            (F.col("c") == 1).alias("single"),
            ((F.col("nth") == 1) & (F.col("cnt") > 0)).alias("entry"),
            F.least("copies", F.lit(2)).cast("int").alias("copies"),
        )
        scan = written(scan.where("flag OR open OR entry"), "scan")
        entries = scan.where("entry").withColumn("cnt", F.col("copies"))
        level = lambda part: entries.where(F.col("part") == part).select(*_ENTRY)
        self.levels[at:] = [(size, level(_MERGING))] * merging + [(1, level(_FRESH))] * (fresh is not None)
        return scan.where("flag OR open")

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; returns what it and the levels it met have in common: stretches
        (did, t, start, n, key) with ``flag`` (repeated whole) or ``open`` (needs its windows)."""
        return self.compact(repeats.stretches(docs, self.how))


def repeated_windows(docs: DataFrame, how: repeats.Windows, batches: int) -> DataFrame:
    """Flagged runs of windows (did, t, start, n) whose bytes also start elsewhere."""
    index = SuffixIndex(how)
    batch = F.pmod(F.xxhash64("did", "t"), F.lit(batches))
    found = [index.add(docs.where(batch == b)) for b in range(batches)]
    scan = reduce(DataFrame.unionByName, found)
    # a stretch that was open in one scan may be found whole in a later one: it stays a partner for others
    chosen = scan.where("open").groupBy("did", "t", "start", "n", "key").agg(F.min("single").alias("single"))
    twice = repeats.repeated(docs, chosen, how, earlier=False)
    flags = scan.where("flag").select("did", "t", "start", "n").unionByName(twice)
    return written(flags, "flags")


def remove_repeats(documents: DataFrame, width: int = WIDTH, k: int = K, batches: int = BATCHES) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else, in the
    same document or another; strings are judged on the input and never cross documents.

    Returns one row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), text
    (the bytes that remain, undecodable ones replaced) and sha256 of those bytes. Null and empty texts have no bytes;
    texts shorter than ``width`` stay whole. Equal rows (same id and text) repeat each other, null
    ids are ids like any other. Other columns are not read. An empty table gives no rows.
    """
    how = repeats.Windows(words=False, width=width, k=min(k, width))
    docs = repeats.with_identity(documents)
    flags = repeated_windows(docs, how, batches)

    def make(doc, text, parts, again):
        del again  # equal rows are flagged as repeats of each other already
        raw = np.frombuffer(text, np.uint8)
        gone = repeats.covered(parts, len(raw), width)
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        kept = raw[~gone].tobytes()
        return doc, len(raw), int(gone.sum()), int((edges == 1).sum()), kept.decode(errors="replace"), sha256(kept).hexdigest()

    return repeats.applied(docs, flags, make, "doc_id long, n_bytes long, n_removed long, n_spans long, text string, sha256 string")
