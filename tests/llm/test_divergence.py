"""Source divergence against sums over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lintlake.llm import divergence, queries
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, s int, `a.b` int"


def plain(rows, top=200):
    groups, n, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        terms = [t for t, c in docs[lang].items() if c >= 3]
        sources = sorted(s for x, s in groups if x == lang)
        size = {s: sum(n[lang, s][t] for t in terms) for s in sources}
        share = lambda count, total: 1 + 10**9 * (count + 1) // (total + len(terms))
        p = {s: {t: share(n[lang, s][t], size[s]) for t in terms} for s in sources}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(size.values())) for t in terms}
        f = lambda a, b: (a - b) ** 2 // b
        pair = [(sum(f(p[source][t], p[o][t]) for t in terms), o) for o in sources if o != source]
        term = [(f(p[source][t], q[t]), t) for t in terms if n[lang, source][t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(ranked)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "été", "ÉTÉ", "Ünï", "naïve", "a", "b1c", "x_y", "😀", "ß"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = []
    for _ in range(n):
        source = rng.choice(["s1", "s2", "s10", "S1", "hot", "hot", "hot", None])
        lang = rng.choice(["en", "fr", "en", None, ""])
        rows.append((" ".join(rng.choices(words, k=rng.randrange(60))), lang, source))
    return rows


@pytest.fixture(scope="module")
def rows():
    found = texts(1)
    found += [(None, "en", "none"), ("", "en", "empty"), ("1 2 3 ...", "fr", "signs"), ("alone in its tongue", "xx", "only"), ("two", "yy", "a"), ("two", "yy", "b")]
    found += [("hot words again " * 5000, "en", "hot"), *found[:20]]  # a long text, repeated rows
    return found


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_equals_plain(spark, rows):
    assert result(divergence.divergence(table(spark, rows))) == plain(rows)


def test_in_small_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "_ENTRIES", 7)
    monkeypatch.setattr(divergence, "_PIECE", 11)
    monkeypatch.setattr(divergence, "_ITEMS", 9)
    assert result(divergence.divergence(table(spark, rows).repartition(5), top=3)) == plain(rows, top=3)


def test_ties_and_empty(spark):
    same = [("b a c", "en", s) for s in ("x", "y", "z")]
    assert result(divergence.divergence(table(spark, same))) == plain(same)
    assert result(divergence.divergence(table(spark, []))) == []


def test_tree_says_each_node_and_ancestor_once():
    # three terms share the path (1, 10) -> (2, 20); one goes on to (3, 30)
    offsets = np.array([0, 2, 5])
    source, p, z = np.array([1, 2, 1, 2, 3]), np.array([10, 20, 10, 20, 30]), np.array([1, 2, 1, 2, 3])
    found = list(divergence.tree_corrections(np.zeros(2, np.int64), offsets, source, p, z, np.array([2, 1])))
    assert sum(len(value) for *_, value in found) == 6  # (2,1), (3,2), (3,1), both ways
    total = Counter()
    for _, s, q, value in found:
        for a, b, v in zip(s.tolist(), q.tolist(), value.tolist()):
            total[a, b] += v
    f = lambda a, b: (a - b) ** 2 // b
    shares = {1: (10, 1), 2: (20, 2), 3: (30, 3)}
    for (a, b), times in {(1, 2): 3, (2, 1): 3, (1, 3): 1, (3, 1): 1, (2, 3): 1, (3, 2): 1}.items():
        (pa, za), (pb, zb) = shares[a], shares[b]
        assert total[a, b] == times * (f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb))


def test_query_equals_sql(spark):
    df = queries.op12(spark, SF)
    cursor = connect(SF).execute(queries.ORACLE["op12_source_divergence"])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
