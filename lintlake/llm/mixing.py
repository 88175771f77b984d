"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source gets a target in words (weights, a share of all words, a cap per source).
2. A source's documents fall into ``BLOCKS`` blocks in the order of a seeded hash, which permutes
   them. A source takes whole passes over all blocks while its target allows, then a last pass over
   its first blocks, ending inside one block; within that block documents follow in hash order and
   the last one is taken in part, so every source meets its target to the word.
3. The quotas of whole blocks are split among output shards: each node of a binary tree draws how
   many blocks of each source go left (multivariate hypergeometric), down to single shards. A shard
   then owns a stretch of each source's permuted blocks, disjoint from all others, and shuffles
   its documents by another hash.

Sources are rows of tables throughout, so there may be any number of them. For the tree they fall into at most
``FAMILIES`` families, dealt by rank: the driver splits the families' quotas, and each family splits what it was dealt
among its sources in a task. Given a family's total, its sources' blocks are again multivariate hypergeometric.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import WORD, column, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCKS = 1024
SHARDS = 16
FAMILIES = 1024
DRAW = 10**9 - 1  # numpy draws from at most that many blocks


def ranked_sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``rank, source, source_size, weight``: the sources numbered from 0 by code point, null last; weights repeat.

    Numbered within ranges of sources, plus the sources of the ranges before; no window sees all of them.
    """
    order = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = written(sums.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    rank = (F.col("offset") + F.col("place")).alias("rank")
    numbered = ranges.withColumn("place", place).join(offsets, "range").select(rank, "source", "source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return numbered.withColumn("weight", weight)


def source_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` with ``target``: ``share`` of all words split by weight; what exceeds ``cap`` times a source's size is
    reshared by weight among the others until none is above. Each round is one aggregate of one row."""
    limit = cap * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight, closed = share * (whole["size"] or 0), whole["weight"] or 1.0, 0
    while True:
        split = F.lit(left) * F.col("weight") / F.lit(weight)
        full = sources.where(split > limit).agg(F.count(F.lit(1)).alias("n"), F.sum(limit).alias("size"), F.sum("weight").alias("weight")).first()
        if full["n"] <= closed or full["weight"] >= whole["weight"]:
            return sources.withColumn("target", F.least(split, limit))
        closed, left, weight = full["n"], share * whole["size"] - full["size"], whole["weight"] - full["weight"]


def _drawn(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` of the blocks of ``quotas``, multivariate hypergeometric; more blocks than can be drawn from go in equal bundles."""
    total = int(quotas.sum())
    if not total:
        return quotas * 0
    bundle = total // DRAW + 1
    drawn = rng.multivariate_hypergeometric(quotas // bundle, min(n // bundle, int((quotas // bundle).sum())), method="marginals") * bundle
    if bundle == 1:
        return drawn
    while rest := n - int(drawn.sum()):
        pool = np.minimum(quotas - drawn, bundle)
        drawn = drawn + rng.multivariate_hypergeometric(pool, min(rest, int(pool.sum())), method="marginals")
    return drawn


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator, totals: Iterable[int] | None = None) -> np.ndarray:
    """``quotas`` (blocks by source) split among ``shards``: an array of shards x sources whose sum over shards is
    ``quotas``. The shards get the blocks that ``totals`` says; without it their sizes differ by at most the tree's rounding."""
    if shards == 1:
        return quotas[None, :]
    half, totals = shards // 2, None if totals is None else list(totals)
    n = round(int(quotas.sum()) * half / shards) if totals is None else sum(totals[:half])
    drawn = _drawn(quotas, n, rng)
    parts = (None, None) if totals is None else (totals[:half], totals[half:])
    return np.vstack([split_tree(drawn, half, rng, parts[0]), split_tree(quotas - drawn, shards - half, rng, parts[1])])


def shard_stops(quotas: DataFrame, shards: int, seed: int, families: int = FAMILIES) -> DataFrame:
    """``rank, stops``: of each of the sources ``rank, slots`` the slot at which each shard's stretch ends."""
    dealt = quotas.select("rank", "slots", (F.col("rank") % families).alias("family"))
    sums = {r["family"]: r["n"] for r in dealt.groupBy("family").agg(F.sum("slots").alias("n")).collect()}  # FAMILIES rows
    tree = split_tree(np.array([sums[f] for f in range(len(sums))], np.int64), shards, np.random.default_rng(seed))

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, family = rows.sort_values("rank"), int(key[0])
        own = split_tree(rows["slots"].to_numpy(np.int64), shards, np.random.default_rng([seed, family]), tree[:, family].tolist())
        return pd.DataFrame({"rank": rows["rank"].to_numpy(), "stops": list(np.cumsum(own, axis=0).T)})

    return dealt.groupBy("family").applyInPandas(split, "rank long, stops array<long>")


def sized_documents(documents: DataFrame, carry: str | None = None) -> DataFrame:
    """Each document's (doc_id, source, size), its block and the hash that orders it.

    ``size`` counts words; a null text has none. Rows of one id share block and order. ``carry``
    names a column that keeps the whole row.
    """
    key = F.xxhash64(F.lit("mix"), "doc_id")
    return documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(key, F.lit(BLOCKS)).cast("int").alias("block"),
        F.xxhash64(F.lit("within"), "doc_id").alias("place"),
        *([F.struct(*map(column, documents.columns)).alias(carry)] if carry else []),
    )


def _same(left: str, right: str):
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def mix(documents: DataFrame, shards: int = SHARDS, seed: int = 17, carry: str | None = None) -> DataFrame:
    """What the mix takes of every document.

    Returns one row per input row: doc_id, source, size, source_size, target (its source's, in
    words), taken (words, repeats counted), passes (whole repeats), part (words of a last repeat,
    which may be partial), shards (the output shard of each repeat) and place (the order inside a
    shard). Reruns agree. Documents without words take nothing; null is a source like any other and
    comes last. An empty table gives no rows.

    Documents are read once for their sizes; after that only tables of sources, blocks and one edge
    block a source are joined, which Spark broadcasts where their files are small.
    """
    base = sized_documents(documents, carry)
    sized = written(base.drop(carry) if carry else base, "sized")
    size, words = F.col("source_size"), F.rint("target").cast("long")
    passes = F.when(size > 0, F.least(F.lit(int(CAP)), F.floor(words / size))).otherwise(F.lit(0)).cast("int")
    targets = source_targets(written(ranked_sources(sized), "ranked")).withColumn("passes", passes)
    sources = written(targets.withColumn("rest", words - F.col("passes") * size).drop("weight"), "sources")

    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # BLOCKS rows
    before = blocks.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    last = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("words"))
    cut = before.alias("d").join(sources.alias("s"), _same("d", "s")).select("rank", "block", last.alias("last"))
    # one row a source: the last block it takes once more, and how many words of that
    edge = cut.where("last > 0").groupBy("rank").agg(F.max("block").alias("edge"), F.max_by("last", "block").alias("edge_words"))
    edged = sources.join(edge, "rank", "left").fillna({"edge": -1, "edge_words": 0})
    quotas = written(edged.withColumn("slots", F.col("passes") * BLOCKS + F.col("edge") + 1), "quotas")
    decided = written(quotas.join(shard_stops(quotas, shards, seed), "rank").drop("rank", "rest", "slots"), "decided")
    known = (base if carry else sized).alias("d").join(decided.alias("s"), _same("d", "s")).drop(F.col("s.source"))
    # inside an edge block documents follow in hash order; only those rows are dealt out
    order = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words_before = F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = known.where("block = edge").withColumn("part", F.least(F.greatest(F.col("edge_words") - words_before, F.lit(0)), F.col("size")))
    others = known.where("block <> edge").withColumn("part", F.when(F.col("block") < F.col("edge"), F.col("size")).otherwise(F.lit(0).cast("long")))
    repeats = F.col("passes") + (F.col("part") > 0).cast("int")
    slot = F.when(repeats > 0, F.transform(F.sequence(F.lit(0), repeats - 1), lambda c: c * BLOCKS + F.col("block"))).otherwise(F.expr("cast(array() as array<int>)"))
    return others.unionByName(at_edge).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"),
        "passes",
        "part",
        F.transform(slot, lambda c: F.size(F.filter("stops", lambda stop: stop <= c))).alias("shards"),
        F.xxhash64(F.lit("shuffle"), "doc_id").alias("place"),
        *([carry] if carry else []),
    )


def mixed_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself, with the columns of ``documents``: each document as often as it is taken
    whole, then the first ``part`` words of it. Documents that are not taken are gone; ``n_chars``,
    if there is one, follows the text. Each row goes to the partition of its shard, in shuffled order.
    """
    words = F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.when(F.col("part") >= F.col("size"), F.col("_row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("part").cast("int")), ""))
    none = F.expr("cast(array() as array<string>)")
    texts = F.concat(F.array_repeat("_row.text", F.col("passes")), F.when(F.col("part") > 0, F.array(head)).otherwise(none))
    taken = mix(documents, shards, carry="_row").where("taken > 0")
    copies = taken.select("_row", "place", F.inline(F.arrays_zip(texts.alias("text"), F.col("shards").alias("shard"))))
    kind = documents.schema

    def value(name):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.length("text").cast(kind[name].dataType).alias(name)
        return F.col("_row").getField(name).alias(name)

    dealt = copies.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place", "text")
    return dealt.select(*[value(c) for c in documents.columns])
