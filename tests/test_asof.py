"""As-of join against a plain search, with ties, gaps, nulls and hot keys."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from lintlake.operators import asof, device

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def plain(left, right, forward):
    out = []
    for key, t, n in left:
        if forward:
            fit = [(-s, tie, v) for k, s, tie, v in right if None not in (k, s, key, t) and k == key and s >= t]
        else:
            fit = [(s, tie, v) for k, s, tie, v in right if None not in (k, s, key, t) and k == key and s <= t]
        out.append((n, max(fit)[2] if fit else None))
    return sorted(out)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [7, 60, 100_000])
def test_equals_plain_search(spark, forward, bucket, monkeypatch):
    monkeypatch.setattr(asof, "SPAN", 3)
    rng = random.Random(bucket)
    keys = ["hot"] * 6 + ["cold", "left only", None]
    left = [(rng.choice(keys), rng.choice([None, *range(-300, 900, 13)]), n) for n in range(120)]
    keys = ["hot"] * 6 + ["cold", "right only", None]
    # gaps of many empty buckets, equal times with other ties
    right = [(rng.choice(keys), rng.choice([None, *range(-200, -100, 13), *range(500, 800, 13)]), tie, f"v{tie}") for tie in range(90)]
    mine = spark.createDataFrame([(k, at(t), n) for k, t, n in left], "`the key` string, at timestamp, n int")
    theirs = spark.createDataFrame([(k, at(t), tie, v) for k, t, tie, v in right], "`the key` string, bucket timestamp, tie int, value string")
    got = asof.asof_join(mine, theirs, ["the key"], "at", "bucket", ["value"], "found", forward, ["tie"], bucket)
    assert got.columns == ["the key", "at", "n", "found"]
    assert sorted((r["n"], r["found"] and r["found"]["value"]) for r in got.collect()) == plain(left, right, forward)


def test_repeated_rows_and_empty_sides(spark):
    mine = spark.createDataFrame([("a", at(5)), ("a", at(5))], "k string, t timestamp")
    none = spark.createDataFrame([], "k string, s timestamp, v int")
    some = spark.createDataFrame([("a", at(5), 1), ("a", at(5), 2)], "k string, s timestamp, v int")
    assert [r["found"] for r in asof.asof_join(mine, none, ["k"], "t", "s", ["v"]).collect()] == [None, None]
    assert [r["found"]["v"] for r in asof.asof_join(mine, some, ["k"], "t", "s", ["v"]).collect()] == [2, 2]
    assert asof.asof_join(mine.limit(0), some, ["k"], "t", "s", ["v"]).collect() == []


def test_no_window_over_a_whole_key(spark):
    mine = spark.createDataFrame([("a", at(5))], "k string, t timestamp")
    theirs = spark.createDataFrame([("a", at(5), 1)], "k string, s timestamp, v int")
    plan = asof.asof_join(mine, theirs, ["k"], "t", "s", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3
    # rows by key and bucket, buckets by key and span, spans by key
    assert sum("bucket" in w.split("specifiedwindowframe")[-1] for w in windows) == 2


def test_change_around(spark):
    snapshots = spark.createDataFrame(
        [(0, at(0), 50.0, 100.0), (0, at(10), -1.0, 100.0), (0, at(20), 60.0, 100.0), (0, at(40), 90.0, 100.0), (1, at(5), 1.0, 0.0)],
        "device int, ts timestamp, memory_used double, memory_total double",
    )
    requests = spark.createDataFrame(
        [(1, 0, at(12), at(19)), (2, 0, at(20), at(20)), (3, 0, at(-1), at(41)), (4, 1, at(5), at(5)), (5, None, at(5), at(5)), (6, 0, at(30), None)],
        "id int, device int, started timestamp, ended timestamp",
    )
    got = {r["id"]: (r["before"], r["after"], r["delta"]) for r in device.change_around(requests, snapshots).collect()}
    assert got == {
        1: (50.0, 60.0, 10.0), 2: (60.0, 60.0, 0.0), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None), 6: (60.0, None, None),
    }


def test_snapshots_are_taken_apart_once(spark):
    """Both sides of a request read the same readings; a second pass would parse every snapshot again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    columns = "device long, ts timestamp, event_id long, memory_used double, memory_total double"
    rows = spark.range(40).selectExpr("id % 2 AS device", "timestamp_seconds(id * 1800) AS ts", "id AS event_id", "double(id) AS memory_used", "100.0D AS memory_total")
    requests = spark.range(30).selectExpr("id AS request", "if(id = 7, null, id % 3) AS device", "timestamp_seconds(id * 2000) AS started", "timestamp_seconds(id * 2000 + 600) AS ended")
    found = device.change_around(requests, rows.mapInPandas(counted, columns), tie=["event_id"]).collect()
    assert len(found) == 30 and seen.value == 40
    for row in found:
        own = [i for i in range(40) if row.device is not None and i % 2 == row.device]
        before = max((i for i in own if i * 1800 <= row.request * 2000), default=None)
        after = min((i for i in own if i * 1800 >= row.request * 2000 + 600), default=None)
        assert (row.before, row.after) == tuple(None if i is None else i / 100.0 * 100 for i in (before, after))
