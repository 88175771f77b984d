"""Language identification by inference on a mixture of languages.

A language's model is the distribution of its character n-grams (three bytes of a lower-cased word with
a blank at either end, hashed). A document is a bag of words, each drawn from one of several languages;
a word's likelihood under a language is that of its n-grams. Expectation-maximisation estimates the
document's proportions: words are shared out by proportion times likelihood, and the shares are the next
proportions. Adding a language never lowers the likelihood, so the set of languages is the one of largest
penalised likelihood (``PENALTY`` times the log of the number of words for each language), among the sets
of the largest proportions of the full mixture. The language with the largest proportion is predicted.

Training counts n-grams of all rows it may learn from. The model has at most ``CELLS`` numbers: at most
``LANGUAGES`` languages (the most frequent ones) times the buckets that fit, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import groups_of, text_bytes
from lintlake.llm.hashing import mix, words_of

LANGUAGES = 512
CELLS = 1 << 22
MOST_BITS = 16
SMOOTH = 0.5  # added to each count
PENALTY = 2.0
ROUNDS = 12  # of expectation and maximisation
UNKNOWN = "und"
_BYTES = 1 << 20  # of text taken together
_NUMBERS = 1 << 22  # of words times languages held together
_LETTER = regex.compile(r"\p{L}")
#: everything but letters (and all beyond ASCII) separates words; A-Z become small
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    """Log-likelihoods of n-gram buckets by language; ``names`` by falling number of documents."""

    names: list[str]
    logs: np.ndarray  # buckets x languages

    @property
    def bits(self) -> int:
        return len(self.logs).bit_length() - 1


def bits_for(languages: int) -> int:
    """Buckets (as a power of two) that keep the model within ``CELLS`` numbers."""
    return min(MOST_BITS, (CELLS // max(1, languages)).bit_length() - 1)


def grams_of(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of words of ``raw`` and the n + 1 offsets: one n-gram for each byte of a word,
    that byte in the middle."""
    lengths = stops - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], lengths)
    at = np.repeat(starts, lengths) + inner
    mid = raw[at].astype(np.uint64)
    left = np.where(inner > 0, raw[np.maximum(at - 1, 0)], 32).astype(np.uint64)
    right = np.where(inner < np.repeat(lengths, lengths) - 1, raw[np.minimum(at + 1, len(raw) - 1)], 32).astype(np.uint64)
    return (mix((left << np.uint64(16)) | (mid << np.uint64(8)) | right) >> np.uint64(64 - bits)).astype(np.int64), offsets


def allowed(documents: DataFrame, learn: Column) -> DataFrame:
    return documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn).select("lang", "text")


def train(documents: DataFrame, learn: Column, languages: int = LANGUAGES) -> Model:
    """Learn from the rows of ``documents`` (text, lang) that meet ``learn``; null texts and
    languages teach nothing, repeated rows count each. No such row gives a model without languages."""
    rows = allowed(documents, learn)
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()  # at most ``languages`` rows
    names = [r["lang"] for r in found]
    if not names:
        return Model([], np.zeros((1, 0)))
    bits, code = bits_for(len(names)), {name: i for i, name in enumerate(names)}

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            raw, ends = text_bytes(batch.column(1))
            raw = _LETTERS[raw]
            codes = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for i, j in groups_of(ends, _BYTES):
                own = ends[i : j + 1] - ends[i]
                part = raw[ends[i] : ends[j]]
                starts, stops, _, offsets = words_of(part, own)
                for lo, hi in _slices(starts, stops):
                    buckets, inner = grams_of(part, starts[lo:hi], stops[lo:hi], bits)
                    text = np.searchsorted(offsets, np.arange(lo, hi), "right") - 1
                    of = np.repeat(codes[i + text], np.diff(inner))
                    for c in np.unique(of[of >= 0]).tolist():
                        counts = np.bincount(buckets[of == c], minlength=1 << bits)
                        sums[c] = sums[c] + counts if c in sums else counts
            while len(sums) * (1 << bits) > CELLS:
                yield _cells(*sums.popitem())
        for c, counts in sums.items():
            yield _cells(c, counts)

    def _cells(c, counts):
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["c", "bucket", "n"])

    totals = np.full((1 << bits, len(names)), SMOOTH)
    cells = rows.mapInArrow(run, "c int, bucket int, n long").groupBy("c", "bucket").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # at most CELLS rows
    totals[table.column("bucket").to_numpy(), table.column("c").to_numpy()] += table.column("n").to_numpy()
    return Model(names, np.log(totals / totals.sum(axis=0)))


def _slices(starts: np.ndarray, stops: np.ndarray, most: int = _BYTES) -> Iterator[tuple[int, int]]:
    """Runs of words of at most ``most`` bytes together; a longer word comes alone."""
    yield from groups_of(np.concatenate([[0], np.cumsum(stops - starts)]), most)


def word_scores(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihood of each word under each language, less that of its best language."""
    wide = len(model.names)
    out = np.zeros((len(starts), wide))
    for lo, hi in _slices(starts, stops, max(1, _NUMBERS // wide)):
        buckets, offsets = grams_of(raw, starts[lo:hi], stops[lo:hi], model.bits)
        step = max(1, _NUMBERS // wide)
        if len(buckets) <= step:
            out[lo:hi] = np.add.reduceat(model.logs[buckets], offsets[:-1], axis=0)
        else:  # a single very long word
            for at in range(0, len(buckets), step):
                out[lo] += model.logs[buckets[at : at + step]].sum(axis=0)
    return out - out.max(axis=1, keepdims=True)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins, axis=0)


def proportions(likely: np.ndarray, times: np.ndarray, begins: np.ndarray, open_: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document, over the languages that ``open_`` (documents x languages) allows, and
    the log-likelihoods. ``likely`` holds words x languages, ``begins`` the first word of each document."""
    counts = np.diff(np.append(begins, len(likely)))
    share = open_ / open_.sum(axis=1, keepdims=True)
    words = np.repeat(np.arange(len(begins)), counts)
    total = _sums(times, begins)[:, None]
    for _ in range(rounds):
        joint = likely * share[words]
        joint *= (times / joint.sum(axis=1))[:, None]
        share = _sums(joint, begins) / total
    mixed = np.einsum("wl,wl->w", likely, share[words])
    return share, _sums(times * np.log(mixed), begins)


def infer(scores: np.ndarray, times: np.ndarray, begins: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the chosen languages of each document (rows sum to 1).

    The single best language is the first choice; then the two, three, ... languages with the largest
    proportions of the full mixture, as long as the penalised likelihood grows.
    """
    wide = scores.shape[1]
    likely = np.exp(np.maximum(scores, -60.0))
    ends = np.append(begins, len(scores))
    single = _sums(np.maximum(scores, -60.0) * times[:, None], begins)
    best = single.argmax(axis=1)
    share = np.zeros((len(begins), wide))
    share[np.arange(len(begins)), best] = 1.0
    if wide == 1:
        return share
    value = single.max(axis=1)
    cost = penalty * np.log1p(_sums(times, begins))
    full, most = proportions(likely, times, begins, np.ones_like(share), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    alive = np.flatnonzero(most - value > cost)  # others gain less than one language more costs
    for size in range(2, wide + 1):
        if not len(alive):
            break
        open_ = np.zeros((len(alive), wide))
        np.put_along_axis(open_, order[alive, :size], 1.0, 1)
        rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in alive])
        lengths = ends[alive + 1] - ends[alive]
        own, ll = proportions(likely[rows], times[rows], np.concatenate([[0], np.cumsum(lengths)[:-1]]), open_, rounds)
        better = ll - (size - 1) * cost[alive] > value[alive]
        alive, own, ll = alive[better], own[better], ll[better]
        share[alive] = own
        value[alive] = ll - (size - 1) * cost[alive]
    return share


def _predicted(raw: np.ndarray, ends: np.ndarray, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: no words) and proportion of each of some consecutive texts."""
    best, score = np.full(len(ends) - 1, -1), np.zeros(len(ends) - 1)
    starts, stops, hashes, offsets = words_of(raw, ends)
    if not len(starts):
        return best, score
    text = np.repeat(np.arange(len(ends) - 1), np.diff(offsets))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)  # each word once
    order = np.lexsort((which, text))
    t, w = text[order], which[order]
    begins = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])]))
    times = np.diff(np.append(begins, len(t))).astype(np.float64)
    t, w = t[begins], w[begins]
    words = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1])  # the first word of each text
    scores = word_scores(raw, starts[first], stops[first], model)
    step = max(1, _NUMBERS // len(model.names))
    for i, j in groups_of(np.append(words, len(t)), step):
        lo, hi = words[i], words[j] if j < len(words) else len(t)
        share = infer(scores[w[lo:hi]], times[lo:hi], words[i:j] - lo, penalty)
        best[t[words[i:j]]] = share.argmax(axis=1)
        score[t[words[i:j]]] = share.max(axis=1)
    return best, score


def predict(documents: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents`` (doc_id, text).

    ``score`` is the proportion of the predicted language in the whole text, 1 where only one language
    is chosen. Texts that are null or have no letter are ``und`` with score 0, and so is every text
    where nothing was learnt. Letters that no model knows leave the language with the most documents.
    Equal texts fare alike; repeated rows stay; other columns are not read. An empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType

    def run(batches):
        model = shared.value
        for batch in batches:
            lang, score = [], []
            raw, ends = text_bytes(batch.column(1))
            raw = _LETTERS[raw]
            for i, j in groups_of(ends, _BYTES):
                if model.names:
                    best, own = _predicted(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], model, penalty)
                else:
                    best, own = np.full(j - i, -1), np.zeros(j - i)
                # letters beyond ASCII cannot be told from other signs by their bytes
                for k in np.flatnonzero(best >= 0).tolist():
                    if not _LETTER.search(batch.column(1)[i + k].as_py()):
                        best[k], own[k] = -1, 0.0
                lang += [model.names[b] if b >= 0 else UNKNOWN for b in best.tolist()]
                score += np.clip(own, 0.0, 1.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
