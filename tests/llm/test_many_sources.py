"""A mix over more sources than a driver should hold one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import mixing
from tests.llm.plain_mixing import targets_of


def test_targets_of_random_sources(spark):
    rng = random.Random(3)
    for top in (3, 2000):
        sizes = [rng.randrange(0, top) for _ in range(300)]
        names = [f"s{i:03}" for i in range(299)] + [None]
        sized = spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(7)
        got = mixing.source_targets(mixing.ranked_sources(sized)).orderBy("rank").collect()
        assert [r["source"] for r in got] == names and [r["rank"] for r in got] == list(range(300))
        assert [r["target"] for r in got] == pytest.approx(targets_of(sizes, [(3, 1, 2)[i % 3] for i in range(300)]))


def test_families_share_what_they_were_dealt(spark):
    quotas = spark.range(500).select(F.col("id").alias("rank"), (F.col("id") * 37 % 91).alias("slots"))
    stops = {r["rank"]: r["stops"] for r in mixing.shard_stops(quotas, 5, 1, families=16).collect()}
    assert all(stops[i][-1] == i * 37 % 91 and stops[i] == sorted(stops[i]) for i in range(500))
    dealt = np.diff(np.array([[0, *stops[i]] for i in range(500)]), axis=1).sum(axis=0)
    assert dealt.max() - dealt.min() <= 5


def test_more_blocks_than_one_draw(monkeypatch):
    monkeypatch.setattr(mixing, "DRAW", 50)
    quotas = np.array([0, 7, 400, 33, 1, 60])
    shares = mixing.split_tree(quotas, 6, np.random.default_rng(2))
    assert shares.sum(axis=0).tolist() == quotas.tolist() and (shares >= 0).all()
    assert shares.sum(axis=1).max() - shares.sum(axis=1).min() <= 6


def test_every_document_its_own_source(spark):
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    got = mixing.mix(docs)
    row = got.agg(F.count("*"), F.max(F.abs(F.col("taken") - F.col("target"))), F.sum("target"), F.sum("size")).first()
    assert row[0] == 120_000 and row[1] <= 0.5 and row[2] == pytest.approx(1.5 * row[3])
