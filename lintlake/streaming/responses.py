"""Streamed responses put together once, when they are complete: a keyed state with a timer.

The chunks of a response are stored as they come, one entry each, so what a response writes grows with its
length and not with its square. A response is given out

* once, when its end chunk and all chunks before it have arrived (``complete``), or
* when the watermark passes its time limit, with what has arrived until then (not ``complete``).

Chunks that come after that, that repeat a number, or that lie beyond the end are left out and counted. The
count of a response is given out with it; what comes later is given out when its time limit passes.
Chunks older than the watermark never reach the state; Spark counts them (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lintlake.sources.config import response_chunks


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()
RESPONSE = _fields(request_id=_LONG, kind=_TEXT, text=_TEXT, chunks=_LONG, complete=_FLAG, dropped=_LONG)
#: The state of a response lives in this store; it keeps large state on disk.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class Reassembly(StatefulProcessor):
    """State of a response: its chunks by number, and one row of facts about it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.contents = handle.getMapState("contents", _fields(seq=_LONG), _fields(content=_TEXT))
        # length: chunks up to the end, -1 while unknown; highest: the largest number so far
        self.facts = handle.getValueState("facts", _fields(length=_LONG, arrived=_LONG, highest=_LONG, dropped=_LONG, given=_FLAG))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        if self.facts.exists():
            length, arrived, highest, dropped, given = self.facts.get()
        else:
            length, arrived, highest, dropped, given = -1, 0, -1, 0, False
        began = None
        # in a batch the end chunk may come before others
        for row in sorted(rows, key=lambda r: (r.seq is None, r.seq, not r.ends, r.content or "")):
            began = row.began_ms if began is None else min(began, row.began_ms)
            beyond = row.seq is None or row.seq < 0 or (0 <= length <= row.seq)
            if given or beyond or self.contents.containsKey((row.seq,)):
                dropped += 1
                continue
            self.contents.updateValue((row.seq,), (row.content or "",))
            arrived, highest = arrived + 1, max(highest, row.seq)
            if row.ends:
                length = row.seq + 1
        if length >= 0 and highest >= length:  # chunks beyond an end that came after them
            for (seq,) in [k for k in self.contents.keys() if k[0] >= length]:
                self.contents.removeKey((seq,))
                arrived, dropped = arrived - 1, dropped + 1
            highest = length - 1
        if began is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(began + self.wait_ms)
        if not given and length >= 0 and arrived == length:
            yield self._response(key, True, dropped)
            given, dropped = True, 0
        self.facts.update((length, arrived, highest, dropped, given))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ANN001
        if not self.facts.exists():
            return
        _, _, _, dropped, given = self.facts.get()
        if not given:
            yield self._response(key, False, dropped)
        elif dropped:
            yield Row(request_id=key[0], kind="late", text=None, chunks=0, complete=False, dropped=dropped)
        self.contents.clear()
        self.facts.clear()

    def _response(self, key, complete: bool, dropped: int) -> Row:  # noqa: ANN001
        parts = sorted((seq, content) for (seq,), (content,) in self.contents.iterator())
        self.contents.clear()
        text = "".join(content for _, content in parts)
        return Row(request_id=key[0], kind="response", text=text, chunks=len(parts), complete=complete, dropped=dropped)

    def close(self) -> None:
        pass


def ended_chunks(chunks: DataFrame, column: str = "chunk") -> DataFrame:
    """``chunks`` with ``content`` and ``ends``: whether the chunk names a reason to finish."""
    reason = F.get_json_object(column, "$.choices[0].finish_reason")
    return response_chunks(chunks.withColumn("ends", F.coalesce(reason, F.lit("")) != ""), column)


def finished_responses(chunks: DataFrame, created: str = "created", lateness: str = "10 minutes", wait_seconds: int = 3600) -> DataFrame:
    """Each response of a stream ``request_id, seq, chunk, created`` once, in append mode.

    Gives ``request_id, kind, text, chunks, complete, dropped``: ``kind`` is ``response``, or ``late`` for chunks that
    came after their response was given out. ``created`` is the time a response began, which all its
    chunks carry; ``wait_seconds`` after it (by the watermark) an unfinished response is given out as it
    is and forgotten. Chunks without a number are dropped and counted; those without content are
    empty. Needs the state store of ``STATE_STORE``.
    """
    rows = ended_chunks(chunks.withWatermark(created, lateness)).select(
        "request_id", F.col("seq").cast("long").alias("seq"), "content", "ends", F.unix_millis(created).alias("began_ms"), created
    )
    return rows.groupBy("request_id").transformWithState(Reassembly(wait_seconds * 1000), RESPONSE, "append", "EventTime")


def finished_batch(chunks: DataFrame, now: Column, created: str = "created", wait_seconds: int = 3600) -> DataFrame:
    """What :func:`finished_responses` gives for chunks that have all arrived at once, at watermark ``now``
    (a literal): three aggregates, no state. Of chunks of one number the one that ends, then the least in text order, counts."""
    rows = ended_chunks(chunks).select(
        "request_id", F.col("seq").cast("long").alias("seq"), F.coalesce("content", F.lit("")).alias("content"), "ends", F.col(created).alias("began")
    )
    ends = rows.groupBy("request_id").agg(
        F.min(F.when(F.col("ends") & (F.col("seq") >= 0), F.col("seq"))).alias("last"), F.min("began").alias("began"), F.count(F.lit(1)).alias("total")
    )
    usable = rows.where("seq >= 0").groupBy("request_id", "seq").agg(F.min_by("content", F.struct(~F.col("ends"), "content")).alias("content"))
    inside = usable.join(ends.select("request_id", "last"), "request_id").where("last IS NULL OR seq <= last")
    parts = inside.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.expr("listagg(content, '') WITHIN GROUP (ORDER BY seq)").alias("text")
    )
    both = ends.join(parts, "request_id", "left")
    complete = F.coalesce(F.col("last") + 1 == F.col("chunks"), F.lit(False))
    passed = F.unix_millis("began") + wait_seconds * 1000 <= F.unix_millis(now)
    return both.select(
        "request_id",
        F.lit("response").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"),
        complete.alias("complete"),
        (F.col("total") - F.coalesce("chunks", F.lit(0))).cast("long").alias("dropped"),
        passed.alias("passed"),
    ).where("complete OR passed").drop("passed")
