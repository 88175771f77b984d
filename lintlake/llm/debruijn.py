"""Substring dedup over words by stretches of windows, in place of a De Bruijn graph.

No graph is built: there is no table of k-mer edges and no compaction of chains through joins.
Consecutive ``width``-word windows that share their least ``k``-word substring, the minimiser, are one
stretch, cut within its text (``repeats.stretches``), and one shuffle by minimiser brings together all
stretches that can be equal. Copies of one content are settled whole. Where a minimiser has several
contents, stretches are opened into single windows and compared once more. Coordinates (document,
start) decide which occurrence is the first; flagged windows are not read again, 64-bit hashes decide.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import repeats
from lintlake.llm.common import written
from lintlake.llm.hashing import word_spans

WIDTH = 20
K = 6


def repeated_windows(docs: DataFrame, how: repeats.Windows) -> DataFrame:
    """Flagged runs of windows (did, t, start, n) whose words start earlier somewhere."""
    scan = repeats.compare(repeats.stretches(docs, how)).select(
        "did", "t", "start", "n", "key",
        ((F.col("cnt") == 0) | (F.col("rank") > 1)).alias("flag"),
        ((F.col("cnt") > 0) & (F.col("rank") == 1) & F.col("branches")).alias("open"),
    )
    scan = written(scan.where("flag OR open"), "scan")
    later = repeats.repeated(docs, scan.where("open").withColumn("single", F.lit(True)), how, earlier=True)
    flags = scan.where("flag").select("did", "t", "start", "n").unionByName(later)
    return written(flags, "flags")


def remove_repeats(documents: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier (smaller
    doc_id, or same document and earlier start); windows are judged on the input.

    Returns one row per document: doc_id, n_words, n_removed, text (the kept words, joined by one
    blank), sha256 of it. Null and empty texts have no words; texts of fewer than ``width`` words
    stay whole. Rows of one id but different texts are ordered by a hash of the text; of equal rows
    (same id and text) the later ones count as starting later, null ids come first. Other columns
    are not read. An empty table gives no rows.
    """
    how = repeats.Windows(words=True, width=width, k=min(k, width))
    docs = repeats.with_identity(documents)
    flags = repeated_windows(docs, how)

    def make(doc, text, parts, again):
        raw = np.frombuffer(text, np.uint8)
        starts, ends = word_spans(raw)
        n = len(starts)
        gone = np.full(n, n >= width) if again else repeats.covered(parts, n, width)
        kept = b" ".join(text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
        return doc, n, int(gone.sum()), kept.decode(), sha256(kept).hexdigest()

    return repeats.applied(docs, flags, make, "doc_id long, n_words long, n_removed long, text string, sha256 string")
