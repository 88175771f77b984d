"""Near-duplicate join of documents on word n-grams (Jaccard), with Bayesian candidate pruning.

1. Every text becomes a set of word 5-grams and 100 minimum hashes of it. Documents of equal sets are
   one class; only classes are compared.
2. Twenty bands of five hashes give buckets. Each bucket is named after its least class, its pivot,
   and a class goes to each of its distinct pivots once, however many bands led there.
3. A pivot's classes are compared in pairs of tiles. Hashes are compared 20 at a time; a pair is
   dropped when the posterior probability (uniform prior) that its Jaccard similarity reaches the
   threshold falls below ``TOLERANCE``. The rest is verified on the sets themselves.
4. Tiles return counts and a spanning forest, never pairs; union-find joins the forests.

A pair that meets under several pivots counts under the least one only.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import column, groups_of, text_bytes, unused, written
from lintlake.llm.components import components, local_roots
from lintlake.llm.hashing import Rolling, mix, words_of
from lintlake.llm.repeats import NULL_ID, sifted, with_identity

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
STEP = 20
TOLERANCE = 1e-6
TILE = 1024
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The distinct ``words``-grams of each text as sorted 64-bit hashes; a text of fewer words has
    one gram of all its words, a text without words none."""
    _, _, hashes, offsets = words_of(raw, ends)
    rolling = Rolling(hashes)
    grams = rolling.windows(words)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        else:
            out.append(rolling.of(np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function, 32 bits each."""
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 4096):
            x = grams[at : at + 4096, None] * _SALTS[None, :]
            np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared hashes, the fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    Under a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def summaries(docs: DataFrame) -> DataFrame:
    """(did, t, doc_id, cls, grams, bands) of every document; ``cls`` names its gram set (null for
    none), ``bands`` its buckets."""

    def run(batches):
        for batch in batches:
            raw, ends = text_bytes(batch.column(0))
            cls, count, bands = [], [], []
            for i, j in groups_of(ends, 1 << 20):
                for grams in shingle_sets(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]):
                    count.append(len(grams))
                    if not len(grams):
                        cls.append(None)
                        bands.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        cls.append(int(mix(np.array([mix(grams).sum() + np.uint64(len(grams))]))[0].view(np.int64)))
                        keys = Rolling(mix(signature(grams).astype(np.uint64) + np.uint64(1))).windows(ROWS)[::ROWS]
                        bands.append(mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
            columns = [batch.column(k) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cls, pa.int64()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["did", "t", "doc_id", "cls", "grams", "bands"],
            )

    return docs.select("text", "did", "t", "doc_id").mapInArrow(run, "did long, t long, doc_id long, cls long, grams long, bands array<long>")


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (i sorted) have a Jaccard similarity of ``threshold`` or more, exactly."""
    if not len(i):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    vocabulary, ids = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(vocabulary), bool)
    good = np.zeros(len(i), bool)
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    for lo, hi in zip(cuts, [*cuts[1:], len(i)], strict=True):
        own = ids[starts[i[lo]] : starts[i[lo] + 1]]
        marked[own] = True
        partners = j[lo:hi]
        n = sizes[partners]
        at = np.repeat(starts[partners] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        common = np.add.reduceat(marked[ids[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        good[lo:hi] = common >= threshold * (sizes[i[lo]] + n - common) - 1e-9
        marked[own] = False
    return good


def candidates(left: np.ndarray, right: np.ndarray, limits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two signature blocks that survive the incremental comparison."""
    matches = np.zeros((len(left), len(right)), np.int16)
    i = j = None
    for stop, least in limits.items():
        for k in range(stop - STEP, stop):
            if i is None:
                matches += left[:, k][:, None] == right[:, k][None, :]
            else:
                matches += left[i, k] == right[j, k]
        if i is None:
            i, j = np.nonzero(matches >= least)
            matches = matches[i, j]
        else:
            alive = matches >= least
            i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, n_links (other documents with similarity >= ``threshold``,
    copies counted), component_id (least doc_id of its group), kept (it is the one that stays: least
    doc_id, then a hash of the text).

    Similarity is that of the sets of 5-word grams. Texts without words (null, empty, blank) link with
    nothing and stay; texts of one to four words are one gram. Equal rows (same id and text) are copies
    of each other and fare alike here; ``keep_first`` takes one of them. Null ids come first and are named null.
    Other columns are not read. An empty table gives no rows.
    """
    docs = with_identity(documents)
    every = written(summaries(docs), "summaries")
    some = every.where("cls IS NOT NULL")
    classes = some.groupBy("cls").agg(F.count("*").alias("copies"), F.min(F.struct("did", "t")).alias("first"))
    buckets = some.select("cls", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("cls").alias("pivot"), F.max("cls").alias("most")).where("pivot <> most")
    meets = buckets.join(shared, "bucket").select("cls", "pivot").distinct()
    members = written(meets.groupBy("cls").agg(F.sort_array(F.collect_set("pivot")).alias("pivots")), "members")
    sizes = members.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))

    # one text of each class that meets others
    chosen = written(
        some.join(members, "cls").groupBy("cls").agg(F.min(F.struct("did", "t")).alias("at"), F.count("*").alias("copies"), F.first("pivots").alias("pivots"))
        .select("cls", "copies", "pivots", "at.did", "at.t"),
        "chosen",
    )
    likely, _ = sifted(docs.select("text", "did", "t"), chosen)
    # equal rows are one text
    texts = likely.join(chosen, ["did", "t"]).select("text", "cls", "copies", F.explode("pivots").alias("pivot"), "pivots")
    dealt = texts.join(sizes, "pivot").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lower = F.filter("pivots", lambda p: p < F.col("pivot"))  # where a pair may have met before
    pairs = met.select("pivot", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "cls", "copies", "text", lower.alias("lower"))
    limits = least_matches(threshold)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").reset_index(drop=True)
        ta, tb = pdf.ta.iloc[0], pdf.tb.iloc[0]
        sets = []
        for text in pdf.text:
            raw = np.frombuffer(text.encode(), np.uint8)
            sets.append(shingle_sets(raw, np.array([0, len(raw)]))[0])
        signs = np.stack([signature(s) for s in sets])
        tiles = pdf.tile.to_numpy()
        left = np.flatnonzero(tiles == ta)
        right = left if ta == tb else np.flatnonzero(tiles == tb)
        i, j = candidates(signs[left], signs[right], limits)
        if ta == tb:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        lower = [frozenset(x) for x in pdf.lower]
        if any(lower):
            fresh = np.array([not (lower[a] and lower[b] and lower[a] & lower[b]) for a, b in zip(i, j, strict=True)], bool)
            i, j = i[fresh], j[fresh]
        good = verified(sets, i, j, threshold)
        i, j = i[good], j[good]
        copies = pdf.copies.to_numpy()
        links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
        names = pdf.cls.to_numpy()
        roots = local_roots(len(pdf), i, j)
        some = links > 0
        return pd.DataFrame({"cls": names[some], "root": names[roots[some]], "links": links[some].astype(np.int64)})

    found = written(pairs.groupBy("pivot", "ta", "tb").applyInPandas(compare, "cls long, root long, links long"), "found")
    parts = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    grouped = classes.join(links, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cls"))
    firsts = grouped.groupBy("part").agg(F.min("first").alias("least"))
    decided = grouped.join(firsts, "part").select("cls", "copies", F.coalesce("links", F.lit(0)).alias("links"), "least")
    named = F.when(F.col("least.did") != NULL_ID, F.col("least.did"))
    known = some.join(decided, "cls").select(
        "doc_id", "t", (F.col("links") + F.col("copies") - 1).alias("n_links"), named.alias("component_id"), (F.struct("did", "t") == F.col("least")).alias("kept")
    )
    alone = every.where("cls IS NULL").select("doc_id", "t", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def keep_first(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with one row of each group of near duplicates, all columns kept, whatever their names."""
    did, t = unused(documents, "did", "t")
    kept = near_duplicates(documents, threshold).where("kept").select(F.col("doc_id").alias(did), F.col("t").alias(t)).dropDuplicates([did, t])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(did)) & (F.xxhash64("text") == F.col(t))
    rows = documents.join(kept, same)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # equal rows are one document; texts without words all stay
    one = rows.where(words).dropDuplicates([did, t])
    return one.unionByName(rows.where(~words)).select(*[column(c) for c in documents.columns])
