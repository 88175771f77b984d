"""Repeated windows, lines, near documents and vectors against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import debruijn, embedding_dedup, jaccard_join, line_dedup, repeats, suffix_index
from lintlake.llm.components import components


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words(make, rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_KEY", hot)
    got = {r["doc_id"]: r for r in debruijn.remove_repeats(make(rows)).collect()}
    seen = set()
    for doc, text, _ in in_order(rows):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[doc]["n_words"], got[doc]["n_removed"]) == (len(words), sum(gone))
        assert got[doc]["sha256"] == hashlib.sha256(kept.encode()).hexdigest() and got[doc]["text"] == kept
    assert debruijn.remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("batches, hot", [(1, 20_000), (5, 20_000), (2, 1)])
def test_bytes(make, rows, monkeypatch, batches, hot):
    monkeypatch.setattr(repeats, "HOT_KEY", hot)
    rows = [r for r in rows if r[0] != 11]
    got = {r["doc_id"]: r for r in suffix_index.remove_repeats(make(rows), batches=batches).collect()}
    texts = {i: (t or "").encode() for i, t, _ in rows}
    counts = Counter(b[i : i + 200] for b in texts.values() for i in range(len(b) - 199))
    for doc, raw in texts.items():
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if counts[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        row = got[doc]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(raw), int(gone.sum()), spans), doc
        assert row["sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_index.remove_repeats(make([]), batches=1).count() == 0


def test_levels_grow_geometrically(make, rows):
    index = suffix_index.SuffixIndex(repeats.Windows(words=False, width=200, k=32))
    docs = repeats.with_identity(make(rows[:6]))
    for _ in range(5):
        index.add(docs)
    index.compact()
    assert [size for size, _ in index.levels] == [4, 1]


def shingles(line):
    return frozenset(line[i : i + 7] for i in range(len(line) - 6)) if len(line) >= 7 else frozenset([line])


def test_lines(make, rows):
    rows = [r for r in rows if r[0] != 11] + [(30 + k, f"{rows[11][1]}\ntail {k} of a line that is long enough to be compared {'y' * k}", "a") for k in range(25)]
    got = {r["doc_id"]: r for r in line_dedup.duplicate_lines(make(rows)).collect()}
    lines = [(doc, k, line) for doc, text, _ in in_order(rows) if text is not None for k, line in enumerate(text.split("\n")) if line.strip()]
    names = sorted({line for *_, line in lines})
    sets = [shingles(n) for n in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots, at = roots_of(range(len(names)), links), {n: k for k, n in enumerate(names)}
    seen, gone = set(), {doc: [] for doc, *_ in rows}
    for doc, k, line in lines:
        root = roots[at[line]]
        if root in seen:
            gone[doc].append(k)
        seen.add(root)
    assert {doc: got[doc]["removed_lines"] for doc in gone} == gone
    assert line_dedup.duplicate_lines(make([])).count() == 0
    kept = line_dedup.without_duplicates(make(rows))
    assert kept.columns == make(rows).columns
    assert {r["doc_id"] for r in kept.collect()} >= {6, 7, 8, 1, 4}


def test_near_documents(make, rows):
    extra = (40, "one two", "z")
    docs = make([*rows, extra, extra])
    got = jaccard_join.near_duplicates(docs).collect()
    table = in_order([*rows, extra, extra])
    sets = []
    for _, text, _ in table:
        words = words_of(text)
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    n = len(table)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    degree = Counter(x for link in links for x in link)
    roots = roots_of(range(n), links)
    want = sorted(((table[i][0], degree[i], table[roots[i]][0]) for i in range(n)), key=str)
    assert sorted(((r["doc_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({roots[i] for i in range(n)})
    assert jaccard_join.near_duplicates(make([])).count() == 0


def test_bayesian_limits():
    limits = jaccard_join.least_matches()
    assert all(0 < m < n for n, m in limits.items()) and limits[100] > limits[20]


def test_vectors(shared):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    vectors = np.concatenate([base, base[:10] + rng.normal(scale=0.05, size=(10, 16)), base[:5]])
    rows = [(k, v.tolist(), k % 2 if k < 30 else (k - 30) % 10 % 2) for k, v in enumerate(vectors)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0, None], 1), (104, rows[0][1], None), (105, [], 0), (106, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = shared.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (4, 1024):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        links = [(i, j) for i in range(45) for j in range(i) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
        degree, roots = Counter(x for link in links for x in link), roots_of(range(45), links)
        assert links and all((got[k]["n_links"], got[k]["component_id"]) == (degree[k], roots[k]) for k in range(45))
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(100, 107))


def test_components(shared):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0), (None, 5)]
    got = {r["node"]: r["component"] for r in components(shared.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots_of([*range(41), *range(100, 140)], [x for x in links if None not in x])
