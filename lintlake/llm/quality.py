"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A document's n-grams are words, word pairs, and runs of one to three word shapes (letter case,
digits, the kind of the last sign, and whether the word repeats the one before). The weight vector
has a fixed size, so it may be broadcast. Training reads a bounded sample of the labelled rows;
scoring is one narrow step over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import groups_of, mapped, small_batches, text_bytes
from lintlake.llm.hashing import mix, words_of

BITS = 18
SAMPLE_ROWS = 8_000  # labelled rows that training reads at most
SAMPLE_BYTES = 24 << 20  # of their text; texts that come after are not learnt from
_BYTES = 1 << 18  # of text that are taken apart at once
SCALE = 8.0  # of the mean over a document's n-grams


def ngrams(raw: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of consecutive texts, and the n + 1 offsets into them."""
    starts, stops, words, offsets = words_of(raw, ends)
    n = len(words)
    first, last = raw[starts], raw[stops - 1] if n else np.zeros(0, np.uint8)

    def kind(x):  # capital, small, digit, beyond ASCII, or the sign itself
        out = x.astype(np.uint64)
        out[(x >= 65) & (x <= 90)] = 1
        out[(x >= 97) & (x <= 122)] = 2
        out[(x >= 48) & (x <= 57)] = 3
        out[x >= 128] = 4
        return out

    second = raw[np.minimum(starts + 1, stops - 1)] if n else first
    text = np.repeat(np.arange(len(ends) - 1), np.diff(offsets))
    repeats = np.zeros(n, np.uint64)
    repeats[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shape = mix(((kind(first) * 256 + kind(second)) * 256 + kind(last)) * np.uint64(2) + repeats + np.uint64(1))

    def run(values, width, salt):
        out = values.copy()
        with np.errstate(over="ignore"):
            for k in range(1, width):
                out[:-k] = out[:-k] * np.uint64(0x100000001B3) + values[k:]
        inside = np.arange(n) + width <= offsets[1:][text] if n else np.zeros(0, bool)
        return (mix(out ^ np.uint64(salt)) >> np.uint64(64 - bits))[inside], text[inside]

    parts = [run(words, 1, 11), run(words, 2, 12), run(shape, 1, 13), run(shape, 2, 14), run(shape, 3, 15)]
    owner = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(ends) - 1)
    return np.concatenate([p[0] for p in parts])[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


class FollowTheLeader:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, size: int, alpha=0.3, beta=1.0, l1=0.002, l2=0.002):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, counts: np.ndarray, label: float) -> None:
        """One update from a text's distinct features and how often each occurs."""
        x = np.append(SCALE * counts / max(1, int(counts.sum())), 1.0)
        at = np.append(at.astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS, passes: int = 2) -> np.ndarray:
    """Weights (2**bits + 1 of them) from ``labelled`` (text, label, order), at most ``rows`` rows.

    ``label`` is 0 or 1; rows without one teach nothing. One task reads the rows that come first in the
    order of ``order``, text and label, as long as they hold at most ``SAMPLE_BYTES`` together. It keeps
    the distinct features of a text and their counts. No rows give weights of zero.
    """
    chosen = labelled.where("label IS NOT NULL").select("text", F.col("label").cast("double").alias("label"), "order")
    chosen = chosen.orderBy("order", "text", "label").limit(rows)

    def run(batches):
        model, seen, left = FollowTheLeader(1 << bits), [], SAMPLE_BYTES
        for batch in batches:
            raw, ends = text_bytes(batch.column(0))
            n = int(np.searchsorted(ends, ends[0] + max(0, left), "right")) - 1
            left = left - int(ends[n] - ends[0]) if n == len(ends) - 1 else 0
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in groups_of(ends[: n + 1], _BYTES):
                at, offsets = ngrams(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], bits)
                for k in range(j - i):
                    own, counts = np.unique(at[offsets[k] : offsets[k + 1]], return_counts=True)
                    seen.append((own.astype(np.uint32), counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), labels[i + k]))
                    model.learn(*seen[-1])
        for _ in range(passes - 1):
            for own, counts, label in seen:
                model.learn(own, counts, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    one = chosen.repartition(1).sortWithinPartitions("order", "text", "label")
    got = one.mapInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0][0], "<f4").astype(np.float64) if got else np.zeros((1 << bits) + 1)


def sample(documents: DataFrame, labels: DataFrame, allowed, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents with (text, label, order), chosen by a hash of their id.

    A document labelled more than once gets the label of the majority (1 on a tie); labels that are
    null or belong to no document are left out. ``allowed`` is a condition on ``doc_id``.
    """
    ids = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(allowed)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # ``rows`` bounds it


def score(df: DataFrame, weights: np.ndarray, bits: int = BITS, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1, higher: label 1 likelier) from every whole text; an empty or null text
    gets the score of the bias alone. A column already named ``out`` is replaced."""
    keep = [c for c in df.columns if c != out]
    at = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in small_batches(batches, at):
            raw, ends = text_bytes(batch.column(at))
            scores = np.zeros(len(ends) - 1)
            for i, j in groups_of(ends, _BYTES):
                features, offsets = ngrams(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], bits)
                sums = np.concatenate([[0.0], np.cumsum(w[features])])
                counts = np.diff(offsets)
                scores[i:j] = SCALE * (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, counts)
            scores = 1 / (1 + np.exp(-np.clip(scores + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    return mapped(df, keep, run, schema)
