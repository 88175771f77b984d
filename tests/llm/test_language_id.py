"""Language identification: a plain twin of the inference, mixtures, held-out accuracy, odd texts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import language_id, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, `a.b` int"
TONGUES = {
    "aa": ["bana", "nabo", "obana", "bonan", "anab"],
    "bb": ["xyzzy", "zyxen", "qyzz", "zzyq", "yxyz"],
    "cc": ["élan", "été", "çate", "lançé", "éçat"],
}


def prose(rng, lang, n):
    return " ".join(rng.choice(TONGUES[lang]).title() for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate([*["aa"] * 30, *["bb"] * 20, *["cc"] * 10])]
    return language_id.train(table(spark, rows), F.lit(True)), rows


def test_names_and_shares(spark, learnt):
    model, rows = learnt
    assert model.names == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.predict(table(spark, rows), model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] == 1.0 for i, _, lang in rows)


def test_mixture_proportions(spark, learnt):
    rng = random.Random(2)
    rows = [(1, prose(rng, "aa", 300) + " " + prose(rng, "bb", 100), None), (2, prose(rng, "cc", 50) + " " + prose(rng, "bb", 350), None)]
    got = {r["doc_id"]: r for r in language_id.predict(table(spark, rows), learnt[0]).collect()}
    assert got[1]["lang_pred"] == "aa" and abs(got[1]["score"] - 0.75) < 0.05
    assert got[2]["lang_pred"] == "bb" and abs(got[2]["score"] - 0.875) < 0.05


def twin(scores, times, penalty, rounds):
    """One document, in plain Python."""
    like = [[math.exp(max(v, -60.0)) for v in row] for row in scores]
    wide = len(like[0])

    def fit(open_):
        share = {l: 1 / len(open_) for l in open_}
        for _ in range(rounds):
            new = dict.fromkeys(open_, 0.0)
            for row, n in zip(like, times):
                total = sum(row[l] * share[l] for l in open_)
                for l in open_:
                    new[l] += n * row[l] * share[l] / total
            share = {l: v / sum(times) for l, v in new.items()}
        return share, sum(n * math.log(sum(row[l] * share[l] for l in open_)) for row, n in zip(like, times))

    singles = [sum(n * max(row[l], -60.0) for row, n in zip(scores, times)) for l in range(wide)]
    chosen, value = {max(range(wide), key=lambda l: (singles[l], -l)): 1.0}, max(singles)
    cost = penalty * math.log1p(sum(times))
    full, _ = fit(list(range(wide)))
    order = sorted(full, key=lambda l: (-full[l], l))
    for size in range(2, wide + 1):
        share, ll = fit(order[:size])
        if ll - (size - 1) * cost <= value:
            break
        chosen, value = share, ll - (size - 1) * cost
    return [chosen.get(l, 0.0) for l in range(wide)]


def test_inference_equals_plain_twin():
    rng = np.random.default_rng(5)
    parts, sizes = [], [1, 2, 30, 80, 7, 200]
    for k, n in enumerate(sizes):
        scores = rng.normal(size=(n, 4)) * (1 + k) * 2
        parts.append(scores - scores.max(axis=1, keepdims=True))
    times = rng.integers(1, 5, sum(sizes)).astype(float)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    got = language_id.infer(np.concatenate(parts), times, begins, 2.0, 12)
    for i, scores in enumerate(parts):
        own = times[begins[i] : begins[i] + sizes[i]].tolist()
        assert np.allclose(got[i], twin(scores.tolist(), own, 2.0, 12), atol=1e-9)
    assert (got > 0).sum(axis=1).max() > 1


def test_odd_texts(spark, learnt):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, " 12 -- 3\n", "aa"), (4, "—…😀", "aa"), (5, "ΩΩΩ", "bb"), (6, "bana", None), (7, "bana " * 60_000, "aa"), (8, "b" * 300_000, "aa"), (None, "xyzzy", None), (9, "élan", "aa"), (9, "élan", "aa")]
    got = [tuple(r) for r in language_id.predict(table(spark, rows), learnt[0]).collect()]
    assert len(got) == len(rows) and all(0.0 <= s <= 1.0 for *_, s in got)
    named = {i: (lang, s) for i, lang, s in got}
    assert {named[i] for i in (1, 2, 3, 4)} == {("und", 0.0)}
    assert named[5][0] in learnt[0].names and named[8][0] in learnt[0].names
    assert [named[i][0] for i in (6, 7, None, 9)] == ["aa", "aa", "bb", "cc"]
    assert got.count((9, "cc", 1.0)) == 2


def test_same_in_small_parts(spark, learnt, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, "aa", 40) + " " + prose(rng, "bb", i), None) for i in range(60)]
    whole = sorted(tuple(r) for r in language_id.predict(table(spark, rows), learnt[0]).collect())
    small = [language_id._predicted(np.frombuffer(language_id._LETTERS[np.frombuffer(t.encode(), np.uint8)], np.uint8), np.array([0, len(t.encode())]), learnt[0], language_id.PENALTY) for _, t, _ in rows]
    assert [(learnt[0].names[b[0]], round(float(s[0]), 9)) for b, s in small] == [(lang, round(s, 9)) for _, lang, s in whole]


def test_nothing_learnt(spark):
    empty = table(spark, [])
    model = language_id.train(empty, F.lit(True))
    assert model.names == [] and language_id.predict(empty, model).collect() == []
    got = language_id.predict(table(spark, [(1, "bana", "aa")]), model).collect()
    assert [tuple(r) for r in got] == [(1, "und", 0.0)]


def test_most_frequent_languages_only(spark, learnt):
    model = language_id.train(table(spark, learnt[1]), F.lit(True), languages=2)
    assert model.names == ["aa", "bb"]
    assert language_id.bits_for(512) == 13 and language_id.bits_for(4) == 16


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op13(spark, SF).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert n > 100 and right / n >= 0.98
