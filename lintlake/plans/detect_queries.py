"""Queries over rules, scoring and detection, batch and streaming."""

import numpy as np
from pyspark.sql import functions as F

from lintlake.operators import device, rules, scoring
from lintlake.plans.catalog import query
from lintlake.plans.finding_queries import found
from lintlake.plans.source_queries import SNAPSHOT_SQL, page_sql
from lintlake.plans.views import K, project, table, view, with_views
from lintlake.session import shared_path
from lintlake.sources import config
from lintlake.streaming import changes, jobs, responses

TOKEN, IPV4, EMAIL = r'token = "[0-9a-f]{40}"', r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"[A-Za-z0-9_.+-]@[A-Za-z0-9-]+\.[A-Za-z]"
SECRET_RULES = (
    rules.LineRule("token", TOKEN, "Hardcoded token", "token = "),
    rules.LineRule("ipv4", IPV4, "IPv4 address", "."),
    rules.LineRule("email", EMAIL, "E-mail address", "@"),
)
PAGE_RULES = (
    rules.LineRule("script", r"<script[^>]*>[^<]", "Inline script", "<script"),
    rules.LineRule("style", r"<style>", "Inline style", "<style>"),
    rules.LineRule("comment", r"<!--.*?-->", "HTML comment", "<!--"),
)


def _hits_sql(source: str, key: str, text: str, rule_set) -> str:
    """Rows per (line, rule) in SQL: ``hits(key, pos, line_number, variable_name, reason)``."""
    values = ", ".join(
        f"({i}, '{r.variable_name}', '{r.pattern}', '{r.reason}')" for i, r in enumerate(rule_set)
    )
    return f"""WITH l AS (SELECT {key}, string_split({text}, chr(10)) AS a FROM {source})
, e AS (SELECT {key}, unnest(a) AS line_text, generate_subscripts(a, 1) AS line_number FROM l)
, rules(rule_pos, variable_name, pattern, reason) AS (VALUES {values})
, hits AS (SELECT {key}, line_number, rule_pos, variable_name, reason,
    row_number() OVER (PARTITION BY {key} ORDER BY line_number, rule_pos) - 1 AS pos
  FROM e, rules WHERE regexp_matches(line_text, pattern))
"""


VERDICT_SQL = (
    _hits_sql("documents", "doc_id", "text", SECRET_RULES)
    + """, r AS (SELECT doc_id, count(*) AS n, string_agg('- Line: ' || CAST(line_number AS STRING) || ', Variable: '
    || variable_name || ', Reason: ' || reason, chr(10) ORDER BY pos) AS t FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS findings, coalesce(r.t, 'No issues found.') AS summary, r.n IS NULL AS passed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""
)


@query("j9_scan_verdicts", VERDICT_SQL)
def flagship(spark, sf):
    """Every document with its secret findings rolled up and its verdict, in one pass without a shuffle."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return rules.scan_verdicts(documents, SECRET_RULES, ["doc_id"])


@query(
    "j9_scan_lines",
    _hits_sql("documents", "doc_id", "text", SECRET_RULES)
    + "SELECT doc_id, pos, line_number, variable_name, reason FROM hits",
)
def j9(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    hits = rules.scan_lines(documents, SECRET_RULES, ["doc_id"])
    return hits.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "line_number")})


@query(
    "j9_scan_pages",
    _hits_sql("pages", "page_id", "html", PAGE_RULES)
    + "SELECT page_id, pos, line_number, variable_name, reason FROM hits",
)
def j9_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    hits = rules.scan_lines(pages, PAGE_RULES, ["page_id"], "html")
    return hits.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "line_number")})


# -- scoring -----------------------------------------------------------------------


@query(
    "g1_argmax",
    """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS predicted FROM embeddings""",
)
def g1(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", scoring.argmax(F.col("embedding")).alias("predicted"))


def mark_logits(texts):
    """A stand-in model: marks of assignments and addresses against a fixed margin."""
    marks = texts.str.count("[=@]").to_numpy(dtype=np.float32)
    return np.stack([np.full_like(marks, 0.5), marks], axis=1)


@query(
    "g1_classify",
    r"""
SELECT doc_id, CAST(greatest(ceil(len(regexp_extract_all(text, '\S+')) / 512), 1) AS BIGINT) AS windows,
  CAST(regexp_matches(text, '[=@]') AS INT) AS label FROM documents""",
)
def g1_classify(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return scoring.classify(documents, mark_logits, ["doc_id"])


@query(
    "g2_yes_no",
    """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'YES' ELSE 'NO' END AS verdict,
  CASE WHEN toxic = 1 THEN 'Insecure code detected. Please review and apply necessary security measures.'
  ELSE 'No obvious vulnerabilities detected. However, further manual review is recommended.' END AS message FROM labels""",
)
def g2(spark, sf):
    toxic = F.col("toxic")
    return table(spark, sf, "labels").select(
        "doc_id", scoring.yes_no(toxic).alias("verdict"), scoring.verdict_message(toxic).alias("message")
    )


WEIGHTS = (("token", 4.0), ("=", 2.0), ("the", 0.25), ("der", 0.25), ("les", 0.25))
SCORES_SQL = r"""WITH w(token, weight) AS (VALUES ('token', 4.0::DOUBLE), ('=', 2.0), ('the', 0.25), ('der', 0.25), ('les', 0.25))
, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS token FROM documents)
, s AS (SELECT doc_id, sum(weight) AS score FROM t JOIN w USING (token) GROUP BY doc_id)
, scores AS (SELECT d.doc_id, coalesce(s.score, 0.0) AS score, CAST(coalesce(s.score, 0.0) >= 6 AS INT) AS label
  FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)
"""


def scored(spark, sf):
    weights = spark.createDataFrame(WEIGHTS, "token string, weight double")
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return scoring.weighted_scores(documents, weights, ["doc_id"], 6.0)


@query("g3_weighted_scores", SCORES_SQL + "SELECT * FROM scores")
def g3(spark, sf):
    return scored(spark, sf)


@query(
    "j14_detection_quality",
    SCORES_SQL
    + """SELECT count(*) FILTER (s.label = 1 AND l.toxic = 1) AS true_positives,
  count(*) FILTER (s.label = 1 AND l.toxic = 0) AS false_positives,
  count(*) FILTER (s.label = 0 AND l.toxic = 1) AS false_negatives,
  count(*) FILTER (s.label = 0 AND l.toxic = 0) AS true_negatives FROM scores s JOIN labels l USING (doc_id)""",
)
def j14(spark, sf):
    verdicts = scoring.verdict_map(scored(spark, sf), "doc_id")
    return scoring.detection_quality(verdicts, table(spark, sf, "labels"), ["doc_id"], "toxic")


@query(
    "a12_verdict_totals",
    SCORES_SQL + "SELECT count(*) AS files, count(*) FILTER (label = 1) AS insecure_files FROM scores",
)
def a12(spark, sf):
    return scoring.verdict_totals(scoring.verdict_map(scored(spark, sf), "doc_id"))


@query("a12_verdict_map", SCORES_SQL + "SELECT doc_id, CASE WHEN label = 1 THEN 'YES' ELSE 'NO' END AS verdict FROM scores")
def a12_map(spark, sf):
    return scoring.verdict_map(scored(spark, sf), "doc_id")


@query(
    "j10_detector_output",
    with_views("v_findings")
    + """, v AS (SELECT c_custkey AS file_id, 'corpus/f' || CAST(c_custkey AS STRING)
    || CASE WHEN c_custkey % 11 = 0 THEN '_unit_test' ELSE '' END || '.py' AS path,
    CASE WHEN c_acctbal < 0 THEN 'YES' ELSE 'NO' END AS verdict FROM customer)
SELECT v.path, v.verdict, f.tool, f.pos, f.line, f.message FROM v LEFT JOIN v_findings f ON f.path = v.path""",
)
def j10(spark, sf):
    verdicts = table(spark, sf, "customer").selectExpr(
        "'corpus/f' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 11 = 0 THEN '_unit_test' ELSE '' END || '.py' AS path",
        "CASE WHEN c_acctbal < 0 THEN 'YES' ELSE 'NO' END AS verdict",
    )
    rows = scoring.detector_output(verdicts, found(spark, sf).select("path", "tool", "pos", "line", "message"))
    return rows.select("path", "verdict", "tool", "pos", "line", "message")


# -- devices -------------------------------------------------------------------------


@query(
    "a15_memory_change",
    SNAPSHOT_SQL
    + """, m AS (SELECT device, event_id, memory_used / memory_total * 100 AS p FROM snapshots WHERE memory_used >= 0)
SELECT device, arg_min(p, event_id) AS "before", arg_max(p, event_id) AS "after",
  arg_max(p, event_id) - arg_min(p, event_id) AS delta FROM m GROUP BY device""",
)
def a15(spark, sf):
    snapshots = config.device_snapshots(view(spark, sf, "v_telemetry")).filter(F.col("memory_used") >= 0)
    return device.memory_change(snapshots, ["device"], ["event_id"])


# Requests and snapshots by the minute, so that many share a time; device 2 has no snapshots at all.
REQUESTS = {
    "request_id": "event_id",
    "device": "user_id % 3",
    "started": "date_trunc('minute', ts)",
    "seconds": f"CAST({K} % 50 AS BIGINT) * 60",
}


@query(
    "a15_change_around_request",
    SNAPSHOT_SQL
    + """, known AS (SELECT device, date_trunc('minute', ts) AS "at", arg_max(memory_used / memory_total * 100, event_id) AS p
    FROM snapshots WHERE memory_used >= 0 AND memory_total > 0 GROUP BY ALL)
, requests AS (SELECT """
    + ", ".join(f"{e} AS {c}" for c, e in REQUESTS.items())
    + """ FROM events WHERE event_type <> 'view')
SELECT r.request_id, b.p AS "before", a.p AS "after", a.p - b.p AS delta
FROM requests r ASOF LEFT JOIN known b ON r.device = b.device AND r.started >= b."at"
ASOF LEFT JOIN known a ON r.device = a.device AND r.started + to_seconds(r.seconds) <= a."at\"""",
)
def a15_around(spark, sf):
    """Memory in use right before and right after each request."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").where("event_type <> 'view'")
    requests = events.selectExpr(*[f"{e} AS {c}" for c, e in REQUESTS.items()])
    requests = requests.withColumn("started", F.col("started").cast("timestamp"))
    ended = F.timestamp_micros(F.unix_micros("started") + F.col("seconds") * 1_000_000)
    snapshots = config.device_snapshots(view(spark, sf, "v_telemetry")).withColumn("ts", minute)
    found = device.change_around(requests.withColumn("ended", ended), snapshots, tie=["event_id"])
    return found.select("request_id", "before", "after", "delta")


WINDOWS_SQL = (
    SNAPSHOT_SQL
    + ", w AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, device, count(*) AS samples, "
    + ", ".join(
        f"{f}(CASE WHEN {c} >= 0 THEN {c} END) AS {f}_{c}"
        for c in ("power_draw", "memory_used", "gpu_utilization", "temperature")
        for f in ("avg", "max")
    )
    + """ FROM snapshots GROUP BY ALL)
SELECT window_start, device, samples, round(avg_power_draw, 6) AS avg_power_draw, max_power_draw,
  round(avg_memory_used, 6) AS avg_memory_used, max_memory_used,
  round(avg_gpu_utilization, 6) AS avg_gpu_utilization, max_gpu_utilization, round(avg_temperature, 6) AS avg_temperature,
  max_temperature FROM w"""
)


def _comparable(windows):
    rounded = {c: F.round(c, 6) for c in ("avg_power_draw", "avg_memory_used", "avg_temperature", "avg_gpu_utilization")}
    start = F.unix_timestamp(F.col("window_start").cast("timestamp")).cast("bigint")
    return windows.withColumns({"window_start": start, **rounded})


@query("t2_device_windows", WINDOWS_SQL)
def t2(spark, sf):
    """The batch form."""
    return _comparable(device.device_windows(config.device_snapshots(view(spark, sf, "v_telemetry"))))


# -- streams ---------------------------------------------------------------------------


def stream(spark, sf, name):
    """One of the given tables as a file stream; a path to a single file has to be a glob."""
    return jobs.file_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


@query("t2_device_windows_stream", WINDOWS_SQL)
def t2_stream(spark, sf):
    """The same over a stream with a watermark."""
    snapshots = project(stream(spark, sf, "events"), "v_telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = jobs.monitored_devices(snapshots)
    return _comparable(jobs.upserted(windows, ["window_start", "device"], "device-windows"))


REASSEMBLED_SQL = (
    with_views("v_chunks")
    + f"""
SELECT request_id, {page_sql("seq")} AS page, string_agg(coalesce(
  json_extract_string(chunk, '$.choices[0].delta.content'), ''), '' ORDER BY seq) AS text FROM v_chunks GROUP BY ALL"""
)


@query("t1_reassembled", REASSEMBLED_SQL)
def t1(spark, sf):
    return jobs.reassembled(view(spark, sf, "v_chunks"))


@query("t1_reassembled_stream", REASSEMBLED_SQL)
def t1_stream(spark, sf):
    chunks = project(stream(spark, sf, "conversations"), "v_chunks")
    chunks = chunks.withColumn("created", F.timestamp_seconds(F.col("request_id") * 60))
    return jobs.upserted(jobs.reassembled_stream(chunks), ["request_id", "page"], "responses")


# Conversations as chunks that may end, at every fifth turn; minutes tell when a response began.
ENDED = {
    "request_id": "conv_id",
    "seq": "turn",
    "chunk": "'{\"choices\":[{\"delta\":{\"content\":\"w' || CAST(length(text) AS STRING) || ' \"},\"finish_reason\":' "
    "|| CASE WHEN turn % 4 = 3 THEN '\"stop\"' ELSE 'null' END || '}]}'",
    "minute": "conv_id * 7 + 1",
}
FINISHED_SQL = (
    "WITH chunks AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in ENDED.items())
    + """ FROM conversations)
, ends AS (SELECT request_id, min(seq) FILTER (json_extract_string(chunk, '$.choices[0].finish_reason') = 'stop') AS last,
    count(*) AS total, min("minute") AS "minute" FROM chunks GROUP BY request_id)
, parts AS (SELECT request_id, count(*) AS chunks, string_agg(json_extract_string(chunk, '$.choices[0].delta.content'), '' ORDER BY seq) AS text
    FROM chunks JOIN ends USING (request_id) WHERE last IS NULL OR seq <= last GROUP BY request_id)
, r AS (SELECT request_id, 'response' AS kind, text, chunks, coalesce(last + 1 = chunks, FALSE) AS complete, total - chunks AS dropped,
    "minute" + 60 <= (SELECT max("minute") - 10 FROM chunks) AS passed FROM ends JOIN parts USING (request_id))
SELECT request_id, kind, text, chunks, complete, dropped FROM r WHERE complete OR passed"""
)


def ended(conversations):
    chunks = conversations.selectExpr(*[f"{e} AS `{c}`" for c, e in ENDED.items()])
    return chunks.withColumn("created", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")


@query("t1_finished_responses", FINISHED_SQL)
def t1_finished(spark, sf):
    """The batch form, at the watermark a stream would have reached."""
    chunks = ended(table(spark, sf, "conversations"))
    newest = chunks.agg(F.unix_seconds(F.max("created")).alias("newest")).first()["newest"] or 0  # one row
    return responses.finished_batch(chunks, F.timestamp_seconds(F.lit(newest - 600)))


@query("t1_finished_responses_stream", FINISHED_SQL)
def t1_finished_stream(spark, sf):
    """Each response once, when it ends or its time is over."""
    chunks = ended(stream(spark, sf, "conversations"))
    return jobs.appended(responses.finished_responses(chunks), "finished-responses", responses.STATE_STORE)


@query("t3_scan_stream", VERDICT_SQL)
def t3(spark, sf):
    documents = stream(spark, sf, "documents").select("doc_id", "text")
    return jobs.appended(jobs.scanned_stream(documents, SECRET_RULES, ["doc_id"]), "verdicts")


# Three listings of the documents: each leaves out a fifth, and a third of the texts changes from one to the next.
LISTED = "(doc_id + {d}) % 5 <> 0"
LISTED_TEXT = "CASE WHEN doc_id % 3 < {d} THEN text || chr(10) || 'mail' || doc_id || '@host.example' ELSE text END"
LAST_DROP_SQL = (
    f"WITH last_drop AS (SELECT doc_id, {LISTED_TEXT.format(d=2)} AS text FROM documents WHERE {LISTED.format(d=2)}), "
    + VERDICT_SQL.replace("documents", "last_drop").removeprefix("WITH ")
)


@query("t3_changed_files_stream", LAST_DROP_SQL)
def t3_changes(spark, sf):
    """Three drops followed by one stream; what is left are the verdicts of the last."""
    root = shared_path(spark, "changes")
    documents = table(spark, sf, "documents").select("doc_id", "text")
    for d in range(3):
        drop = documents.where(LISTED.format(d=d)).selectExpr("doc_id", f"{LISTED_TEXT.format(d=d)} AS text", f"{d}L AS drop")
        drop.write.parquet(f"{root}/drops/n={d}")
        files = jobs.file_stream(spark, f"{root}/drops/*", drop.schema)
        changes.scan_changes(files, f"{root}/out", _verdicts, ["doc_id"]).awaitTermination()
    return changes.current_results(spark, f"{root}/out", _verdicts(documents).schema, ["doc_id"])


def _verdicts(files):
    return rules.scan_verdicts(files, SECRET_RULES, ["doc_id"])
