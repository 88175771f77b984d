"""Queries over sources and sinks."""

from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import paging
from lintlake.operators import symbols as sy
from lintlake.plans.catalog import query
from lintlake.plans.views import table, view, with_views
from lintlake.session import shared_path
from lintlake.sources import config, corpus, reports, sinks, trees

PAGE = paging.PAGE_ROWS


def page_sql(pos: str) -> str:
    return f"CAST(floor({pos} / {PAGE}) AS BIGINT)"


@query(
    "s1_corpus_scan",
    with_views("v_scripts")
    + """
SELECT 's' || CAST(p_partkey AS STRING) || '.py' AS name, '.py' AS ext, text FROM v_scripts""",
)
def s1(spark, sf):
    """Bytes to text files; the file reader itself is covered by a unit test on a real tree."""
    raw = view(spark, sf, "v_scripts").select("path", F.encode("text", "UTF-8").alias("content"))
    readable = raw.filter(F.is_valid_utf8(F.col("content").cast("string")))
    return corpus.as_files(corpus.select_python_files(readable)).drop("path")


# Files as they come: some with the newlines of other systems, some empty, some no text at all.
TREE_FORM = "p_partkey % 10"


@query(
    "s1_tree_scan",
    with_views("v_scripts")
    + f"""
SELECT 's' || CAST(p_partkey AS STRING) || '.py' AS name,
  CASE {TREE_FORM} WHEN 0 THEN 'empty' WHEN 2 THEN 'not_text' ELSE 'ok' END AS status,
  CAST(CASE {TREE_FORM} WHEN 0 THEN 0 WHEN 1 THEN strlen(replace(text, chr(10), chr(13) || chr(10))) WHEN 2 THEN strlen(text) + 1
    ELSE strlen(text) END AS BIGINT) AS bytes,
  CASE {TREE_FORM} WHEN 0 THEN '' WHEN 2 THEN NULL ELSE text END AS text FROM v_scripts""",
)
def s1_tree(spark, sf):
    """Writes a tree of files and reads it back."""
    form, target = F.expr(TREE_FORM), shared_path(spark, "tree")
    text = F.when(form == 0, F.lit("")).when(form == 1, F.replace("text", F.lit("\n"), F.lit("\r\n")))
    content = F.encode(text.when(form == 3, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text")), "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("FF")))
    files = view(spark, sf, "v_scripts").select("path", F.when(form == 2, broken).otherwise(content).alias("content"))
    trees.write_tree(files, target)
    return trees.read_tree(spark, target).withColumn("name", tx.base_name(F.col("path"))).select("name", "status", "bytes", "text")


@query(
    "s2_select_python_files",
    with_views("v_files") + "\nSELECT file_id, path FROM v_files WHERE right(path, 3) = '.py'",
)
def s2(spark, sf):
    return corpus.select_python_files(view(spark, sf, "v_files")).select("file_id", "path")


@query(
    "s3_bandit_reports",
    with_views("v_bandit_reports")
    + """, r AS (
  SELECT path, report_id, json_extract(report, '$.results[*]') AS results FROM v_bandit_reports)
, e AS (SELECT path, report_id, unnest(results) AS f, generate_subscripts(results, 1) - 1 AS pos FROM r)
SELECT path, report_id, CAST(pos AS BIGINT) AS pos, json_extract_string(f, '$.test_id') AS test_id,
  CAST(json_extract_string(f, '$.line_number') AS BIGINT) AS line_number,
  replace(replace(CAST(json_extract(f, '$.line_range') AS VARCHAR), '[', ''), ']', '') AS line_range,
  json_extract_string(f, '$.issue_text') AS issue_text
FROM e""",
)
def s3(spark, sf):
    found = reports.bandit_findings(view(spark, sf, "v_bandit_reports"), "report", ["path", "report_id"])
    return found.select(
        "path", "report_id", F.col("pos").cast("bigint").alias("pos"), "test_id",
        F.col("line_number").cast("bigint").alias("line_number"),
        F.array_join(F.col("line_range").cast("array<string>"), ",").alias("line_range"), "issue_text",
    )


@query(
    "s4_dodgy_reports",
    with_views("v_dodgy_reports")
    + """
SELECT path, report_id, CAST(0 AS BIGINT) AS pos,
  CAST(json_extract_string(report, '$.issues[0].line_number') AS BIGINT) AS line_number,
  json_extract_string(report, '$.issues[0].variable_name') AS variable_name,
  json_extract_string(report, '$.issues[0].reason') AS reason
FROM v_dodgy_reports WHERE json_extract(report, '$.issues') IS NOT NULL""",
)
def s4(spark, sf):
    found = reports.dodgy_findings(view(spark, sf, "v_dodgy_reports"), "report", ["path", "report_id"])
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "line_number")})


@query(
    "s5_semgrep_results",
    with_views("v_semgrep_raw")
    + """
SELECT path, pos, CAST(json_extract_string(result_json, '$.start.line') AS BIGINT) AS line,
  json_extract_string(result_json, '$.extra.message') AS message,
  CASE json_type(result_json, '$.extra.metadata.owasp') WHEN 'ARRAY'
    THEN array_to_string(json_extract_string(result_json, '$.extra.metadata.owasp[*]'), ',')
    ELSE coalesce(json_extract_string(result_json, '$.extra.metadata.owasp'), '') END AS owasp,
  coalesce(json_extract_string(result_json, '$.extra.metadata.cwe'), '') AS cwe
FROM v_semgrep_raw""",
)
def s5(spark, sf):
    found = reports.semgrep_results(view(spark, sf, "v_semgrep_raw"), "result_json", ["path", "pos"])
    return found.withColumns(
        {
            "line": F.col("line").cast("bigint"),
            "owasp": F.array_join("owasp", ","),
            "cwe": F.array_join("cwe", ","),
        }
    )


@query(
    "s6_typecheck_output",
    with_views("v_typecheck")
    + """, l AS (SELECT path, report_id, string_split(output, chr(10)) AS a FROM v_typecheck)
, e AS (SELECT path, report_id, unnest(a) AS line_text, generate_subscripts(a, 1) - 1 AS pos FROM l)
, m AS (SELECT *, regexp_extract(line_text, '^([^:]*):([^:]*):(.*)$', ['file', 'num', 'msg']) AS p FROM e
  WHERE regexp_full_match(line_text, '[^:]*:[^:]*:.*'))
SELECT path, report_id, CAST(pos AS BIGINT) AS pos, TRY_CAST(trim(p.num) AS BIGINT) AS line, trim(p.msg) AS message
FROM m WHERE TRY_CAST(trim(p.num) AS BIGINT) IS NOT NULL""",
)
def s6(spark, sf):
    found = reports.typecheck_findings(view(spark, sf, "v_typecheck"), "output", ["path", "report_id"])
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "s7_unused_code_reports",
    with_views("v_unused")
    + """
SELECT path, report_id, CAST(0 AS BIGINT) AS pos,
  coalesce(json_extract_string(report, '$[0].type'), 'Unknown') AS "type",
  coalesce(json_extract_string(report, '$[0].name'), 'N/A') AS name
FROM v_unused""",
)
def s7(spark, sf):
    found = reports.unused_code_findings(view(spark, sf, "v_unused"), "report", ["path", "report_id"])
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "s8_guidance_map",
    """
SELECT event_id, 'k' AS needle, CAST(json_extract(props, '$.k') AS VARCHAR) AS guidance FROM events""",
)
def s8(spark, sf):
    found = config.guidance_map(table(spark, sf, "events"), "props", ["event_id"])
    return found.select("event_id", "needle", "guidance")


@query(
    "s9_prompt_catalogue",
    """
SELECT role, text AS content FROM (
  SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations)
WHERE rn = 1""",
)
def s9(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return config.prompt_catalogue(rows, "conv_id", "turn")


@query(
    "s10_response_chunks",
    with_views("v_chunks")
    + """
SELECT request_id, seq, coalesce(json_extract_string(chunk, '$.choices[0].delta.content'), '') AS content
FROM v_chunks""",
)
def s10(spark, sf):
    return config.response_chunks(view(spark, sf, "v_chunks"))


SNAPSHOT_SQL = (
    with_views("v_telemetry")
    + """, n AS (SELECT event_id, ts, device, snapshot,
  TRY_CAST(regexp_extract(snapshot, 'GPU use \\(%\\): ([0-9])', 1) AS DOUBLE) AS gpu_use,
  TRY_CAST(regexp_extract(snapshot, 'VRAM Total Used Memory \\(B\\): ([0-9]+)', 1) AS DOUBLE) AS used,
  TRY_CAST(regexp_extract(snapshot, 'VRAM Total Memory \\(B\\): ([0-9]+)', 1) AS DOUBLE) AS total,
  TRY_CAST(regexp_extract(snapshot, 'Sensor edge\\) \\(C\\): ([0-9.]+)', 1) AS DOUBLE) AS temp,
  TRY_CAST(regexp_extract(snapshot, 'Average Graphics Package Power \\(W\\): ([0-9.]+)', 1) AS DOUBLE) AS draw,
  TRY_CAST(regexp_extract(snapshot, 'Max Graphics Package Power \\(W\\): ([0-9.]+)', 1) AS DOUBLE) AS cap,
  TRY_CAST(regexp_extract(snapshot, 'dcefclk clock level: [0-9]+: \\(([0-9]+)Mhz', 1) AS DOUBLE) AS dcef,
  TRY_CAST(regexp_extract(snapshot, 'mclk clock level: [0-9]+: \\(([0-9]+)Mhz', 1) AS DOUBLE) AS mclk,
  TRY_CAST(regexp_extract(snapshot, 'sclk clock level: [0-9]+: \\(([0-9]+)Mhz', 1) AS DOUBLE) AS sclk
  FROM v_telemetry)
, snapshots AS (SELECT event_id, ts, device,
  'Not found in clinfo output.' AS gpu_name, '6.3.1' AS driver_version,
  regexp_extract(snapshot, 'VBIOS version: ([A-Za-z0-9_-]+)', 1) AS vbios_version,
  CASE WHEN contains(snapshot, 'Performance Level: auto') THEN 'auto' ELSE '-1.0' END AS p_state,
  coalesce(round_even(gpu_use / 100, 2), -1.0) AS gpu_utilization,
  coalesce(used / 1048576, -1.0) AS memory_used, coalesce(total / 1048576, -1.0) AS memory_total,
  coalesce(round_even(used / total, 2), -1.0) AS memory_utilization,
  coalesce(round_even(temp, 0), -1.0) AS temperature, coalesce(round_even(draw, 0), -1.0) AS power_draw,
  coalesce(round_even(cap, 0), -1.0) AS power_default_limit, coalesce(round_even(dcef, 0), -1.0) AS clocks_video,
  coalesce(round_even(mclk, 0), -1.0) AS current_memory_clock,
  coalesce(round_even(sclk, 0), -1.0) AS current_graphics_clock, coalesce(round_even(sclk, 0), -1.0) AS clocks_sm
  FROM n)
"""
)


@query("s11_device_snapshots", SNAPSHOT_SQL + "SELECT * EXCLUDE (ts) FROM snapshots")
def s11(spark, sf):
    return config.device_snapshots(view(spark, sf, "v_telemetry").drop("ts"))


FINDING_COLUMNS = ["path", "run", "tool", "pos", "rule_id", "line", "message"]


@query(
    "k1_write_findings",
    with_views("v_findings") + "\nSELECT path, run, tool, pos, rule_id, line, message, tag FROM v_findings",
)
def k1(spark, sf):
    target = shared_path(spark, "findings")
    rows = view(spark, sf, "v_findings")
    sinks.write_findings(rows.select(*FINDING_COLUMNS, F.create_map(F.lit("tag"), "tag").alias("attrs")), target)
    return sinks.read_findings(spark, target).select(*FINDING_COLUMNS, F.col("attrs")["tag"].alias("tag"))


@query(
    "k1_reports_per_file",
    with_views("v_findings")
    + """, files AS (SELECT path, count(*) AS n FROM v_findings GROUP BY path)
, b AS (SELECT path, CAST(n AS BIGINT) AS n, 'bandit_corpus_' || replace(replace(path, 'corpus/', ''), '.py', '') || '.json' AS report FROM files)
SELECT report, 'ok' AS status, path AS file, count(f.pos) AS results, min(f.pos) AS first_pos,
  arg_min(f.message, f.pos) AS first_message, max(n) AS loc FROM b LEFT JOIN (SELECT * FROM v_findings WHERE tool = 'bandit') f USING (path)
GROUP BY report, path""",
)
def k1_files(spark, sf):
    """A report for each file, clean ones included, written and read again."""
    target, rows = shared_path(spark, "reports"), view(spark, sf, "v_findings")
    files = rows.groupBy("path").agg(F.count("*").alias("n"))
    files = files.select("path", F.parse_json(F.to_json(F.struct(F.struct(F.col("n").alias("loc")).alias("_totals")))).alias("metrics"))
    bandit = rows.where("tool = 'bandit'").select("path", "pos", F.col("pos").alias("place"), "rule_id", "line", "message")
    sinks.write_reports(files, bandit, "bandit", target)
    found = sinks.read_reports(spark, target)
    first = F.get("results", F.lit(0))
    return found.select(
        "report", "status", "file", F.size("results").cast("long").alias("results"),
        F.try_variant_get(first, "$.place", "long").alias("first_pos"),
        F.try_variant_get(first, "$.message", "string").alias("first_message"),
        F.try_variant_get("metrics", "$._totals.loc", "long").alias("loc"),
    )


@query(
    "k2_report_path",
    with_views("v_files")
    + """, s AS (SELECT file_id, path, string_split(path, '/') AS p FROM v_files)
, b AS (SELECT file_id, p[1] || '_' || p[2] AS folder, p[3] AS base FROM s)
SELECT file_id, 'bandit_' || folder || '_'
  || CASE WHEN contains(base, '.') THEN string_split(base, '.')[1] ELSE base END || '.json' AS report FROM b""",
)
def k2(spark, sf):
    return view(spark, sf, "v_files").select("file_id", tx.report_path(F.col("path")).alias("report"))


ATTEMPTS_SQL = (
    with_views("v_attempts")
    + """, attempts AS (SELECT *, row_number() OVER (PARTITION BY path, section ORDER BY event_id) AS iteration
  FROM v_attempts)
"""
)


def attempts(spark, sf):
    """The fixture's attempts with their 1-based iteration."""
    ranked = paging.positions(view(spark, sf, "v_attempts"), ["path", "section"], "event_id", "_rank")
    return ranked.withColumn("iteration", F.col("_rank") + 1).drop("_rank")


@query(
    "k3_attempt_path",
    ATTEMPTS_SQL
    + """SELECT section, iteration,
  path || '_iteration_' || section || '_' || CAST(iteration AS STRING) || '.py' AS attempt_path FROM attempts""",
)
def k3(spark, sf):
    name = tx.attempt_path(F.col("path"), F.col("section"), F.col("iteration"), F.lit(".py"))
    return attempts(spark, sf).select("section", "iteration", name.alias("attempt_path"))


METHODS_SQL = """, methods AS (SELECT path, name, arg_max(code, pos) AS code, min(pos) AS pos
  FROM v_sections GROUP BY path, name)
"""


@query(
    "k4_consolidate_methods",
    with_views("v_sections")
    + METHODS_SQL
    + """SELECT path, CAST(0 AS BIGINT) AS page, string_agg(code || chr(10) || chr(10), '' ORDER BY name) AS text
FROM methods GROUP BY path""",
)
def k4(spark, sf):
    return sinks.consolidate_methods(sy.method_table(view(spark, sf, "v_sections")))


COMBINED_SQL = (
    with_views("v_sections", "v_imports")
    + """, inside AS (SELECT project, file_id, name, arg_min(code, pos) AS code, min(pos) AS pos
  FROM v_sections GROUP BY ALL)
, funcs AS (SELECT project, name, arg_max(code, file_id) AS code, min(file_id) AS first_file,
  arg_min(pos, file_id) AS first_pos FROM inside GROUP BY project, name)
, stmts AS (SELECT DISTINCT project, code AS statement FROM v_imports)
"""
)


def combined(spark, sf):
    functions = sy.combined_functions(view(spark, sf, "v_sections"))
    imports = sy.combined_imports(view(spark, sf, "v_imports"))
    return functions, imports


@query(
    "k5_combined_module",
    COMBINED_SQL
    + """, i AS (SELECT project, string_agg(statement, chr(10) ORDER BY statement) AS t FROM stmts GROUP BY project)
, f AS (SELECT project, string_agg(code || chr(10) || chr(10), '' ORDER BY first_file, first_pos) AS t,
  string_agg(name || '()', chr(10) || '    ' ORDER BY first_file, first_pos) AS c FROM funcs GROUP BY project)
SELECT coalesce(i.project, f.project) AS project, CAST(0 AS BIGINT) AS page,
  coalesce(i.t, '') || chr(10) || chr(10) || coalesce(f.t, '') || 'if __name__ == "__main__":' || chr(10) || '    '
  || coalesce(f.c, '') AS code
FROM i FULL JOIN f ON i.project = f.project""",
)
def k5(spark, sf):
    functions, imports = combined(spark, sf)
    return sy.combined_module(functions, imports)
