"""Levels of the byte index: they merge in the query, and a merged one is the index of its batches."""

import pytest
from pyspark.sql import functions as F

from lintlake.llm import repeats, suffix_index

from .test_repeats import test_bytes as bytes_by_brute_force

HOW = repeats.Windows(words=False, width=200, k=32)


def test_levels_merge_in_the_query(make, rows, monkeypatch):
    made, real = [], suffix_index.SuffixIndex
    monkeypatch.setattr(suffix_index, "SuffixIndex", lambda how: made.append(real(how)) or made[-1])
    suffix_index.remove_repeats(make([r for r in rows if r[0] != 11]))
    sizes = [size for size, _ in made[0].levels]
    assert sum(sizes) == suffix_index.BATCHES and max(sizes) > 1


def test_a_merged_level_is_the_index_of_its_batches(make, rows):
    docs = repeats.with_identity(make([r for r in rows if r[0] != 11])).withColumn("batch", F.expr("pmod(xxhash64(did, t), 5)"))
    index = suffix_index.SuffixIndex(HOW)
    for b in range(5):
        index.add(docs.where(f"batch = {b}").drop("batch"))
    assert [size for size, _ in index.levels] == [4, 1]
    for (_, level), batches in zip(index.levels, ("batch < 4", "batch = 4"), strict=True):
        want = {}
        for r in repeats.stretches(docs.where(batches).drop("batch"), HOW).where("cnt > 0").collect():
            at, n = want.get((r.key, r.cls), ((r.did, r.t, r.start), 0))
            want[r.key, r.cls] = min(at, (r.did, r.t, r.start)), n + r.cnt
        got = [((r.key, r.cls), ((r.did, r.t, r.start), r.cnt)) for r in level.collect()]
        assert len(got) == len(want) and dict(got) == {k: (at, min(n, 2)) for k, (at, n) in want.items()}


@pytest.mark.parametrize("batches", [3, 4, 7])
def test_rows_of_merged_levels(make, rows, monkeypatch, batches):
    bytes_by_brute_force(make, rows, monkeypatch, batches, 20_000)
