"""Responses given out once: shuffled, late, repeated and unfinished chunks over several micro-batches."""

import json
import random
import time
from datetime import datetime, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from lintlake.streaming import jobs, responses

SCHEMA = "request_id long, seq long, chunk string, created timestamp"
WAIT = 3600
DAY = 1440  # minutes; times at or before the first watermark, the start of 1970, would count as late


def chunk(text, ends=False):
    delta = {} if text is None else {"content": text}
    return json.dumps({"choices": [{"delta": delta, "finish_reason": "stop" if ends else None}]})


def row(request, seq, text, ends=False, minute=0):
    return (request, seq, chunk(text, ends), datetime.fromtimestamp((DAY + minute) * 60, timezone.utc))


def whole(request, n, minute=0, ends=True):
    return [row(request, i, f"{request}.{i} ", ends and i == n - 1, minute) for i in range(n)]


def streamed(spark, tmp_path, batches):
    """The rows the stream gives for micro-batches of chunks, one file each."""
    source = tmp_path / "in"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"b{number}"))
        time.sleep(1.1)  # files are taken in the order of their times, in seconds
    kind = spark.createDataFrame([], SCHEMA).schema
    stream = jobs.file_stream(spark, str(source / "*"), kind, files_per_batch=1)
    found = jobs.appended(responses.finished_responses(stream, wait_seconds=WAIT), "responses", responses.STATE_STORE)
    return sorted(tuple(r) for r in found.collect())


def batch(spark, rows, newest_minute):
    chunks = spark.createDataFrame(rows, SCHEMA)
    now = F.timestamp_seconds(F.lit((DAY + newest_minute) * 60 - 600))
    return sorted(tuple(r) for r in responses.finished_batch(chunks, now, wait_seconds=WAIT).collect())


def test_shuffled_chunks_equal_the_batch(spark, tmp_path):
    rows = [r for k in range(8) for r in whole(k, k + 1, minute=k)]
    rows += whole(20, 5, minute=0, ends=False)  # never ends
    rows += [r for r in whole(21, 6, minute=1) if r[1] != 2]  # a chunk is missing
    rows += [row(22, 0, "a"), row(22, 1, "b", True), row(22, 5, "beyond"), row(22, None, "no number")]
    rows += [row(23, 0, None), row(23, 1, "x", True)]
    random.Random(4).shuffle(rows)
    last = [row(99, 0, "late enough", False, minute=200)]
    cut = [rows[:15], rows[15:30], rows[30:], last]
    got = streamed(spark, tmp_path, cut)
    # what came after a response was given out is a row of its own in the stream
    late = {r[0]: r[5] for r in got if r[1] == "late"}
    assert sorted((*r[:5], r[5] + late.get(r[0], 0)) for r in got if r[1] == "response") == batch(spark, rows + last, 200)
    kept = {r[0]: r for r in batch(spark, rows + last, 200)}
    assert kept[20][4] is False and kept[20][3] == 5 and kept[21][4] is False and kept[21][3] == 5
    assert kept[22][2:] == ("ab", 2, True, 2) and kept[23][2] == "x" and 99 not in kept


def test_chunks_after_the_response_are_counted(spark, tmp_path):
    first = whole(1, 3) + whole(2, 2)
    again = [row(1, 0, "again"), row(1, 7, "beyond")]  # both after response 1 was given out
    end = [row(9, 0, "x", False, minute=300)]
    got = streamed(spark, tmp_path, [first, again, end])
    assert got == [
        (1, "late", None, 0, False, 2),
        (1, "response", "1.0 1.1 1.2 ", 3, True, 0),
        (2, "response", "2.0 2.1 ", 2, True, 0),
    ]


def test_repeats_before_the_end_are_dropped(spark, tmp_path):
    got = streamed(spark, tmp_path, [[row(1, 0, "a"), row(1, 3, "z")], [row(1, 0, "a"), row(1, 1, "b", True)]])
    assert got == [(1, "response", "ab", 2, True, 2)]


def test_unfinished_input_waits_for_its_time(spark, tmp_path):
    rows = whole(1, 3, minute=0, ends=False)
    assert streamed(spark, tmp_path / "a", [rows, [row(9, 0, "x", False, minute=60)]]) == []
    got = streamed(spark, tmp_path / "b", [rows, [row(9, 0, "x", False, minute=71)]])
    assert got == [(1, "response", "1.0 1.1 1.2 ", 3, False, 0)]


def test_state_holds_each_chunk_once():
    """A chunk is written once and never rewritten: the processor touches only the rows that arrive."""
    n = 40

    class Handle:
        def __init__(self):
            self.writes, self.values, self.maps, self.timers = 0, {}, {}, []

        def getMapState(self, *_):  # noqa: N802
            outer = self

            class Map:
                def containsKey(self, k):  # noqa: N802
                    return k in outer.maps

                def updateValue(self, k, v):  # noqa: N802
                    outer.writes += 1
                    outer.maps[k] = v

                def iterator(self):
                    return iter(outer.maps.items())

                def clear(self):
                    outer.maps = {}

            return Map()

        def getValueState(self, *_):  # noqa: N802
            outer = self

            class Value:
                def exists(self):
                    return "v" in outer.values

                def get(self):
                    return outer.values["v"]

                def update(self, v):
                    outer.values["v"] = v

            return Value()

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    handle, processor = Handle(), responses.Reassembly(1000)
    processor.init(handle)
    out = []
    for i in range(n):
        one = Row(seq=i, content=f"{i} ", ends=i == n - 1, began_ms=0)
        out += list(processor.handleInputRows((1,), iter([one]), None))
    assert handle.writes == n and len(handle.timers) == 1 and not handle.maps
    assert [r.text for r in out] == ["".join(f"{i} " for i in range(n))]
