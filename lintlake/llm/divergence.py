"""Source divergence audit: how far the term shares of each source lie from those of the other sources
of its language, and which terms it uses more than the language as a whole. All numbers are integers.

A share is p = 1 + floor(10**9 (count + 1) / (N + V)); two shares differ by f(p, q) = floor((p - q)**2 / q).
Summing f over all V terms for all pairs of sources would read every term for every pair. Most terms
occur in few sources, so the sum is taken apart. With z the share of a term that a source lacks,

    sum f(p, q) = V f(z_s, z_q)
                + sum over terms of s of f(p, z_q) - f(z_s, z_q)        (one by one, by distinct count)
                + sum over terms of q of f(z_s, q) - f(z_s, z_q)
                + sum over terms of both of f(p, q) - f(p, z_q) - f(z_s, q) + f(z_s, z_q)

The last line comes from a frequent-pattern tree: each term is a row of its nonzero counts in the order
of the sources, equal rows are one row with a multiplicity, and rows are inserted by shared prefix. A
node stands for all rows through it, so what it has to say with each of its ancestors is computed once
and taken times its multiplicity. Rows are dealt out in sorted order, which keeps prefixes together
and still cuts a very common prefix over many tasks: sums of partial trees add up to the same.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import groups_of, written

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP = 200
SALTS = 16
_ENTRIES = 100_000  # (group, term) counts that a task holds before it hands them on
_PIECE = 1 << 20  # bytes of a text that are taken apart at once
_ITEMS = 1 << 16  # items of paths that make one tree
#: ASCII letters in lower case and all bytes beyond ASCII stay, everything else separates terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes):
    """The terms of a text, a bounded number at a time."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many rows each term occurs."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0

        def rows():
            for (lang, source), (n, docs) in held.items():
                if n:
                    terms = list(n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(terms), pa.string()),
                            pa.array([source] * len(terms), pa.string()),
                            pa.array(terms, pa.binary()).cast(pa.string()),
                            pa.array([n[t] for t in terms], pa.int64()),
                            pa.array([docs[t] for t in terms], pa.int64()),
                        ],
                        names=["lang", "source", "term", "n", "docs"],
                    )

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                raw = (text.as_py() or "").encode().translate(_LETTERS)
                for terms in terms_of(raw):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                entries += len(n) - before + (before == 0)
                if entries >= _ENTRIES:
                    yield from rows()
                    held, entries = {}, 0
        yield from rows()

    parts = documents.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), without overflow."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))).cast("long")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Join where one value of ``keys`` may hold much of ``left``: its rows are dealt by ``by`` too."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, [*keys, "salt"]).drop("salt")


def _difference(p, q):
    return (p - q) * (p - q) // q


def tree_corrections(lang: np.ndarray, offsets: np.ndarray, source: np.ndarray, p: np.ndarray, z: np.ndarray, times: np.ndarray):
    """Corrections of one frequent-pattern tree over sorted distinct paths.

    Row i has items ``offsets[i]`` to ``offsets[i + 1]`` (source, share ``p``, share ``z`` without the
    term) and stands for ``times[i]`` terms. Yields (row, s, q, value): the sums of pairs of sources,
    ``row`` being any row of the language.
    """
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(row)) - offsets[:-1][row]
    # an item belongs to the node of the row before as long as all items so far are the same
    above = np.where(row > 0, offsets[np.maximum(row - 1, 0)] + depth, -1)
    known = (row > 0) & (depth < lengths[np.maximum(row - 1, 0)]) & (lang[row] == lang[np.maximum(row - 1, 0)])
    above = np.where(known, above, 0)
    same = known & (source == source[above]) & (p == p[above])
    filled = np.flatnonzero(lengths)
    first = np.full(len(lengths), 0)
    first[filled] = np.minimum.reduceat(np.where(same, len(row), depth), offsets[:-1][filled])
    fresh = depth >= first[row]
    order = np.lexsort((row, depth))
    node = np.empty(len(row), np.int64)
    node[order] = np.cumsum(fresh[order]) - 1
    items = order[fresh[order]]  # the first item of each node, in the order of the nodes
    parent = np.where(depth[items] > 0, node[np.maximum(items - 1, 0)], -1)
    many = np.zeros(len(items), np.int64)
    np.add.at(many, node, times[row])
    ns, np_, nz, owner = source[items], p[items], z[items], row[items]
    child, up = np.arange(len(items)), parent
    while True:  # every node with its parent, then with its parent's parent, ...
        some = up >= 0
        child, up = child[some], up[some]
        if not len(child):
            return
        a, b = up, child
        own = many[b]
        for s, q in ((a, b), (b, a)):
            value = _difference(np_[s], np_[q]) - _difference(np_[s], nz[q]) - _difference(nz[s], np_[q]) + _difference(nz[s], nz[q])
            yield owner[b], ns[s], ns[q], own * value
        up = parent[up]


def _summed(key: np.ndarray, value: np.ndarray):
    """The sums of the values of equal rows of ``key``."""
    order = np.lexsort(key.T[::-1])
    key, value = key[order], value[order]
    begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    return key[begins], np.add.reduceat(value, begins)


def common_terms(paths: DataFrame) -> DataFrame:
    """(lang, s, q, value): the corrections of terms that both sources have, from (lang, path, times)."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lang = table.column("lang").combine_chunks()
            names = lang.dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            path = table.column("path").combine_chunks()
            flat = path.flatten()
            source, p, z = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            offsets = path.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            times = table.column("times").to_numpy()
            for i, j in groups_of(offsets, _ITEMS):
                lo, hi = offsets[i], offsets[j]
                found = []
                # summed level by level, so that no more than one level of all pairs is held
                for at, s, q, value in tree_corrections(code[i:j], offsets[i : j + 1] - lo, source[lo:hi], p[lo:hi], z[lo:hi], times[i:j]):
                    found.append(_summed(np.stack([code[i:j][at], s, q], axis=1), value))
                if not found:
                    continue
                key, sums = _summed(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(key[:, 0])), pa.array(key[:, 1].astype(np.int32)), pa.array(key[:, 2].astype(np.int32)), pa.array(sums)],
                    names=["lang", "s", "q", "value"],
                )

    return paths.mapInArrow(run, "lang string, s int, q int, value long")


def divergence(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Part ``pair``: each source's distance to each other source of its language, all ranks. Part
    ``term``: the terms a source uses more than its language, with their distance, ranks to ``top``.

    Takes text, lang and source (null is the empty string); other columns are not read. Terms are runs
    of ASCII letters and characters beyond ASCII, A-Z in lower case. A language keeps the terms of at
    least ``least_docs`` of its rows; repeated rows count each. Returns lang, source, part, item,
    value, rank (from 1 per source and part; value descending, item ascending in UTF-8). A source
    without terms still has its pairs (value 0 where its language keeps no term). A language with one
    source has no pairs. An empty table gives no rows. Sums must fit 64 bits, which they do below
    10**9 kept terms a language.
    """
    named = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(term_counts(named), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("total")).where(F.col("in_docs") >= least_docs)
    items = written(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "total"), ["lang", "term"]), "items")

    langs = items.select("lang", "term", "n").groupBy("lang", "term").agg(F.sum("n").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sums = items.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source",
        F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int").alias("s"),  # one row a source
        F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
    )
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.greatest("terms", F.lit(1))))
    groups = written(groups.withColumn("z", F.coalesce(zero, F.lit(1))), "groups")

    priced = _salted(items, groups, ["lang", "source"], "term").select(
        "lang", "source", "s", "term", "z",
        share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    priced = written(priced, "priced")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))  # cut to ``top`` before its shuffle
    term = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    mine = groups.select("lang", "s", "z", "terms", "source")
    other = groups.select("lang", F.col("s").alias("o"), F.col("z").alias("y"), F.col("source").alias("item"))
    whole = lambda c: F.sum(c.cast("decimal(38,0)")).alias("value")
    base = _salted(mine, other, ["lang"], "source").where("s <> o")
    base = base.select("lang", "s", F.col("o").alias("q"), (F.col("terms") * apart("z", "y")).alias("value"))
    alike = priced.groupBy("lang", "s", "z", "p").agg(F.count("*").alias("times"))
    singles = _salted(alike, other, ["lang"], "p").where("s <> o")
    singles = singles.select(
        "lang",
        F.inline(F.array(
            F.struct(F.col("s"), F.col("o").alias("q"), (F.col("times") * (apart("p", "y") - apart("z", "y"))).alias("value")),
            F.struct(F.col("o").alias("s"), F.col("s").alias("q"), (F.col("times") * (apart("y", "p") - apart("y", "z"))).alias("value")),
        )),
    )
    row = F.sort_array(F.collect_list(F.struct("s", "p", "z")))
    paths = priced.groupBy("lang", "term").agg(row.alias("path")).where(F.size("path") > 1)
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    trees = common_terms(paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path"))
    values = base.unionByName(singles).unionByName(trees).groupBy("lang", "s", "q").agg(whole(F.col("value")))
    values = values.join(groups.select("lang", "s", "source"), ["lang", "s"])
    values = values.join(groups.select("lang", F.col("s").alias("q"), F.col("source").alias("item")), ["lang", "q"])
    pair = values.select("lang", "source", "item", F.col("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(best))

    parts = [df.withColumn("part", F.lit(name)) for name, df in (("pair", pair), ("term", term))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


DIVERGENCE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
         1 + (CAST({UNIT} AS HUGEINT) * (k.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
