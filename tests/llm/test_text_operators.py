"""Fingerprints, byte BPE, token counts, quality and mixing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from lintlake.llm import bpe, lz_fingerprint, mixing, quality, token_counts
from tests.llm.plain_mixing import targets_of
from lintlake.llm.queries import tokenizer


def naive_parse(text):
    known, cuts, start = set(), [], 0
    while start < len(text):
        end = start + 1
        while end < len(text) and text[start:end] in known:
            end += 1
        known.add(text[start:end])
        cuts.append(end)
        start = end
    return cuts


def test_phrases_and_common_heads():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 60, 900):
        text = "".join(rng.choice("abc d") for _ in range(n))
        cuts = []
        lz_fingerprint.parse(text, set(), 0, cuts)
        assert cuts == naive_parse(text)
        tail = "".join(rng.choice("abxy") for _ in range(n // 3))
        edited = text[: n - n // 3] + tail
        own, other = lz_fingerprint.fingerprints(text, tail, n - n // 3)
        assert np.array_equal(own, lz_fingerprint.fingerprints(text)[0])
        assert np.array_equal(other, lz_fingerprint.fingerprints(edited)[0])


def test_edited_pairs(make, rows):
    got = {r["doc_id"]: r for r in lz_fingerprint.edited_pairs(make(rows), parts=4).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows if i is not None), reverse=True) + [(None, next(t for i, t, _ in rows if i is None))]
    assert len(got) == len(order)
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        row = got[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        signs = [lz_fingerprint.fingerprints(x)[0] for x in (text, edited, after)]
        assert [row["fingerprint"], row["edited_fingerprint"]] == [lz_fingerprint.to_hex(s) for s in signs[:2]]
        assert (row["near_edited"], row["near_next"]) == (lz_fingerprint.likeness(signs[0], signs[1]), lz_fingerprint.likeness(signs[0], signs[2]))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[6]["fingerprint"] == lz_fingerprint.EMPTY
    assert lz_fingerprint.edited_pairs(make([])).count() == 0


def test_bpe_round_trip(make, rows):
    path, pattern = tokenizer()
    whole = bpe.load(path, pattern)
    got = bpe.decode(bpe.encode(make(rows), path, pattern), path, pattern).collect()
    for row in got:
        text = row["text"] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == whole.encode_ordinary(text)
        assert row["decoded"] == text.encode()


def test_pieces_keep_the_ids():
    path, pattern = tokenizer()
    whole = bpe.load(path, pattern)
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(["a", "Z", "7", " ", "\n", "'s", "é", "!", "  ", "\t", "😀", "12"]) for _ in range(600))
        ids = [i for p in bpe.pieces(text, 20) for i in whole.encode_ordinary(p)]
        assert ids == whole.encode_ordinary(text)


def test_edited_counts(make, shared, rows):
    path, pattern = tokenizer()
    whole = bpe.load(path, pattern)
    rng = random.Random(7)
    edits = [[(rng.randrange(900), rng.randrange(1200), rng.choice(["", "ab 12", " ", None])) for _ in range(3)] + [None] for _ in rows]
    edits[0] = None
    table = [(i, t, e) for (i, t, _), e in zip(rows, edits, strict=True)]
    df = shared.createDataFrame(table, f"doc_id long, text string, edits {token_counts.EDIT}")
    got = {r["doc_id"]: r for r in token_counts.count_edits(df, path, pattern).collect()}
    for doc, text, changes in table:
        text = text or ""
        assert got[doc]["n_tokens"] == len(whole.encode_ordinary(text))
        for change in changes or []:
            if change:
                a = min(change[0], len(text))
                b = min(max(a, change[1]), len(text))
                text = text[:a] + (change[2] or "") + text[b:]
        assert got[doc]["edited_text"] == text
        assert got[doc]["edited_tokens"] == len(whole.encode_ordinary(text))


def test_quality(make, shared):
    rng = random.Random(1)
    good = [(k, " ".join(rng.choice(["the", "of", "on", "lake"]) for _ in range(40)), "a") for k in range(150)]
    bad = [(k + 150, " ".join(rng.choice(["BUY!!", "NOW!!", "|"]) for _ in range(40)), "a") for k in range(50)]
    docs = make([*good, *bad, (900, None, "a"), (901, "", "a")])
    labels = shared.createDataFrame([(k, int(k < 150)) for k in range(200)] + [(3, None), (None, 1), (12345, 0)], "doc_id long, quality int")
    weights = quality.train(quality.sample(docs, labels, "true"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert all((scores[k] >= 0.5) == (k < 150) for k in range(200))
    assert scores[900] == scores[901]
    assert not quality.train(quality.sample(docs, labels, "false")).any()


def test_targets():
    assert targets_of([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert targets_of([0, 10], [3, 1]) == pytest.approx([0, 15])
    assert targets_of([], []) == []
    shares = mixing.split_tree(np.array([7, 0, 50]), 5, np.random.default_rng(1))
    assert shares.sum(axis=0).tolist() == [7, 0, 50] and (shares >= 0).all()


def test_mix(make, rows):
    docs = make([*rows, (1, rows[0][1], "a")])
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, (r[:6] for r in got)), key=str) == sorted(map(tuple, (r[:6] for r in mixing.mix(docs).collect())), key=str)
    assert len(got) == len(rows) + 1
    for row in got:
        text = next(t for i, t, _ in rows if i == row["doc_id"])
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= row["taken"] <= 2 * row["size"] and len(row["shards"]) == row["passes"] + (row["part"] > 0)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)
    assert mixing.mix(make([])).count() == 0
