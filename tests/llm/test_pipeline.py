"""The whole pipeline, stage by stage, against plain Python; the trainer and the mix have plain twins."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from lintlake.llm import bpe, mixing, quality, queries  # noqa: E402
from tests.llm.plain_mixing import targets_of  # noqa: E402

from .test_repeats import roots_of, shingles, words_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _id long, _t string, did string, t int, removed_lines int, _cut string, _score string, score int, gone int, cls string, `a.b` string, ids string"


def features(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return Counter(quality.ngrams(raw, np.array([0, len(raw)]))[0].tolist())


def plain_weights(rows, passes=2, alpha=0.3, beta=1.0, l1=0.002, l2=0.002):
    """Follow-the-regularised-leader, one row after the other, in dictionaries."""
    z, n, bias = defaultdict(float), defaultdict(float), "bias"

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for text, label in rows:
            counts = features(text)
            x = {i: quality.SCALE * c / max(1, sum(counts.values())) for i, c in counts.items()} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return lambda text: 1 / (1 + math.exp(-weight(bias) - sum(quality.SCALE * c * weight(i) for i, c in features(text).items()) / max(1, sum(features(text).values()))))


def plain_mix(docs, places):
    """``doc_id`` to (passes, part): whole passes over a source, then words in the order of its places."""
    by_source = defaultdict(list)
    for doc, text, source in docs:
        by_source[source].append((places[doc], doc, len(words_of(text))))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in by_source[s]) for s in names]
    targets = targets_of(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    out = {}
    for name, size, target in zip(names, sizes, targets):
        passes = min(2, round(target) // size) if size else 0
        rest = round(target) - passes * size
        for _, doc, n in sorted(by_source[name]):
            out[doc] = (passes, min(rest, n), n)
            rest -= min(rest, n)
    return out


def places_of(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(
        "doc_id", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(mixing.BLOCKS)).alias("block"), F.xxhash64(F.lit("within"), "doc_id").alias("place")
    )
    return {r.doc_id: (r.block, r.place) for r in rows.collect()}


def head(text, part):
    return "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:part])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(8), [], []
    for k in range(90):
        good = k % 4 != 0
        words = ["lake", "stone", "river", "Under", "the", "of", "cold", "light"] if good else ["BUY!!", "NOW!!", "|", "CLICK"]
        text = "\n".join(" ".join(f"{rng.choice(words)}{rng.randrange(30) if good else ''}" for _ in range(12)) for _ in range(6))
        rows.append((k, text, rng.choice(["a", "a", "b", None])))
        labels.append((k, int(good)))
    line = "all rights reserved by the people of the lake, 2020"
    rows += [(100, rows[1][1] + "\n" + line, "a"), (101, rows[2][1].replace("\n", " "), "b"), (102, rows[3][1] + "\n" + line[:-1] + "1", None)]
    rows += [(103, rows[1][1], "c"), (104, None, "a"), (105, "", "b"), (106, "short line\nshort line", "c")]
    folder = tmp_path_factory.mktemp("corpus")
    extra = ("x", 1)
    data = [(i, t, "en", s, None if t is None else len(t), 5, "x", "x", 1, 2, "x", "x", 7, 1, "x", "dot", "i") for i, t, s in rows]
    assert extra
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, dict(labels)


def crc_fold(doc):
    import zlib

    return zlib.crc32(str(doc).encode()) % 5


def plain_scores(spark, rows, labels):
    taught = [(i, t, labels[i]) for i, t, _ in rows if i in labels and crc_fold(i) != 0]
    order = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i, *_ in taught], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    score = plain_weights([(t, y) for i, t, y in sorted(taught, key=lambda x: order[x[0]])])
    return {i: score(t) for i, t, _ in rows}


def test_scores_equal_the_plain_trainer(spark, corpus):
    folder, rows, labels = corpus
    want = plain_scores(spark, rows, labels)
    got = {r.doc_id: r for r in queries.op9(spark, folder).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-5)
    assert all(r.held_out == (crc_fold(i) == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_mix_equals_the_plain_mix(spark, corpus):
    folder, rows, _ = corpus
    want = plain_mix(rows, places_of(spark, [i for i, *_ in rows]))
    got = {r.doc_id: r for r in queries.op10(spark, folder).collect()}
    assert {i: (r.taken, r.size) for i, r in got.items()} == {i: (p * n + part, n) for i, (p, part, n) in want.items()}


def test_pipeline_equals_plain_python(spark, corpus):
    folder, rows, labels = corpus
    scores = plain_scores(spark, rows, labels)
    docs = [r for r in rows if scores[r[0]] >= queries.THRESHOLD]
    assert 0 < len(docs) < len(rows)
    # lines: the first of each component of near-equal lines stays
    lines = [(i, k, line) for i, t, _ in sorted(docs) if t is not None for k, line in enumerate(t.split("\n")) if line.strip()]
    names = sorted({line for *_, line in lines})
    sets = [shingles(n) for n in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots, at, seen, gone = roots_of(range(len(names)), links), {n: k for k, n in enumerate(names)}, set(), defaultdict(set)
    for i, k, line in lines:
        if roots[at[line]] in seen:
            gone[i].add(k)
        seen.add(roots[at[line]])
    cut = []
    for i, t, s in docs:
        text = t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        if not gone[i] or text.strip():
            cut.append((i, text, s))
    assert len(cut) < len(docs)
    # documents: the least id of each component of near-equal sets of five words stays
    grams = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words_of(t)) else frozenset() for i, t, _ in cut}
    near = [(i, j) for i in grams for j in grams if j < i and grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    root = roots_of(sorted(grams), near)
    kept = [(i, t, s) for i, t, s in cut if root[i] == i]
    mixed = plain_mix(kept, places_of(spark, [i for i, *_ in kept]))
    path, pattern = queries.tokenizer()
    tokenizer = bpe.load(path, pattern)
    want = []
    for i, t, s in kept:
        passes, part, n = mixed[i]
        texts = [t] * passes + ([t if part == n else head(t, part)] if part else [])
        want += [(i, x, s, len(x), len(tokenizer.encode_ordinary(x))) for x in texts if passes * n + part]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*spark.read.parquet(f"{folder}/documents.parquet").columns[:-1], "ids", "n_tokens"]
    found = got.collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.text, r.source, r.n_chars, r.n_tokens) for r in found), key=key) == sorted(want, key=key)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode_ordinary(r.text) for r in found)
    assert {(r._id, r._t, r._cut, r._score, r.score, r["a.b"]) for r in found} == {(5, "x", "x", "x", 7, "dot")}


def test_other_operators_keep_clashing_columns(spark):
    from lintlake.llm import lz_fingerprint, token_counts

    path, pattern = queries.tokenizer()
    df = spark.createDataFrame([(1, "some text", "x", 2, 3)], "doc_id long, text string, `a.b` string, _bit int, `x ``y` int")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("stop"), F.lit("more").alias("insert")))
    assert token_counts.count_edits(df.withColumn("edits", edits), path, pattern).first()["a.b"] == "x"
    assert bpe.decode(bpe.encode(df, path, pattern), path, pattern).first()["decoded"] == b"some text"
    assert lz_fingerprint.add_fingerprints(df).first()["x `y"] == 3


def test_stages_take_empty_tables(spark, tmp_path, corpus):
    folder = corpus[0]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_cluster_needs_a_shared_folder():
    from lintlake.llm.common import shared_folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

    with pytest.raises(ValueError):
        shared_folder(Session())
