"""Streams over several micro-batches give what the batch gives."""

from pyspark.sql import functions as F

from lintlake.plans.detect_queries import SECRET_RULES
from lintlake.plans.views import table, view
from lintlake.operators.rules import scan_verdicts
from lintlake.sources.config import device_snapshots
from lintlake.operators.device import device_windows
from lintlake.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def timed_chunks(spark):
    return view(spark, SF_DIR, "v_chunks").withColumn("created", F.timestamp_seconds(F.col("request_id") * 600))


def test_chunks_in_any_order(spark, tmp_path):
    chunks = timed_chunks(spark)
    chunks.repartition(5, F.rand(1)).write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", chunks.schema, files_per_batch=1)
    got = jobs.upserted(jobs.reassembled_stream(stream, lateness="3650 days"), ["request_id", "page"], "t1")
    assert rows(got) == rows(jobs.reassembled(chunks))


def test_old_responses_leave_the_state(spark, tmp_path):
    chunks = timed_chunks(spark)
    for first in range(0, 2000, 5):  # older responses first
        part = chunks.filter((F.col("request_id") >= first) & (F.col("request_id") < first + 5))
        if part.isEmpty():
            break
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", chunks.schema, files_per_batch=1)
    made = jobs.reassembled_stream(stream, lateness="1 hour")
    query = jobs.upsert_to(made, f"{tmp_path}/log", f"{tmp_path}/mark")
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in state) > 0
    got = jobs.latest(spark, f"{tmp_path}/log", made.schema, ["request_id", "page"])
    assert rows(got) == rows(jobs.reassembled(chunks))


def test_device_windows_over_batches(spark, tmp_path):
    snapshots = view(spark, SF_DIR, "v_telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    snapshots.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", snapshots.schema, files_per_batch=1)
    got = jobs.upserted(jobs.monitored_devices(stream, "3650 days"), ["window_start", "device"], "t2")
    plain = device_windows(device_snapshots(snapshots))
    means = [c for c in plain.columns if c.startswith("avg_")]
    exact = {c: F.round(c, 6) for c in means}
    assert rows(got.withColumns(exact)) == rows(plain.withColumns(exact))


def test_scan_resumes_with_new_files(spark, tmp_path):
    documents = table(spark, SF_DIR, "documents").select("doc_id", "text")
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    first, second = documents.filter("doc_id % 2 = 0"), documents.filter("doc_id % 2 = 1")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, documents.schema)
        jobs.append_to(jobs.scanned_stream(stream, SECRET_RULES, ["doc_id"]), out, mark).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(scan_verdicts(documents, SECRET_RULES, ["doc_id"]))
