"""Queries over projections and scalar functions."""

from pyspark.sql import functions as F

from lintlake.functions import budget, formats
from lintlake.functions import text as tx
from lintlake.operators import code_facts, paging, prompts
from lintlake.operators import symbols as sy
from lintlake.plans.catalog import query
from lintlake.plans.source_queries import COMBINED_SQL, SNAPSHOT_SQL, combined
from lintlake.plans.views import table, view, with_views
from lintlake.sources import config, reports

LIBS_SQL = r"""regexp_extract_all({code}, '(?m)^\s*(?:import\s+[\w.]+|from\s+[\w.]+\s+import\s)', 0)"""


def libs_sql(code: str) -> str:
    """The library list of a code expression, in SQL."""
    found = LIBS_SQL.format(code=code)
    return rf"list_transform({found}, lambda m: regexp_extract(m, '(?:import|from)\s+([\w.]+)', 1))"


@query(
    "p1_extract_libraries",
    with_views("v_code")
    + f""", l AS (SELECT file_id, {libs_sql("code")} AS libs FROM v_code)
SELECT file_id, unnest(libs) AS library, CAST(generate_subscripts(libs, 1) - 1 AS BIGINT) AS pos FROM l""",
)
def p1(spark, sf):
    libs = view(spark, sf, "v_code").select("file_id", F.posexplode(tx.extract_libraries(F.col("code"))).alias("pos", "library"))
    return libs.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "p2_extract_code_block",
    with_views("v_completions")
    + r"""
SELECT conv_id, turn, nullif(regexp_extract(response, '(?s)```python\n(.*?)```', 1), '') AS code FROM v_completions""",
)
def p2(spark, sf):
    return view(spark, sf, "v_completions").select("conv_id", "turn", tx.extract_code_block(F.col("response")).alias("code"))


@query(
    "p3_extract_module_names",
    with_views("v_completions")
    + r"""
SELECT conv_id, turn, array_to_string(
  regexp_extract_all(response, '\b([\p{L}\p{N}_]+)\s+module\b', 1), ',') AS modules FROM v_completions""",
)
def p3(spark, sf):
    names = tx.extract_module_names(F.col("response"))
    return view(spark, sf, "v_completions").select("conv_id", "turn", F.array_join(names, ",").alias("modules"))


@query(
    "p4_titled_fields",
    with_views("v_completions")
    + r""", f AS (SELECT conv_id, turn, response,
  string_split(response, '**Secure Implementation Title**:') AS t,
  string_split(response, '**Secure Implementation Statement:**') AS s,
  string_split(response, '**Secure Code Implementation Statement**:') AS c FROM v_completions)
SELECT conv_id, turn,
  CASE WHEN len(t) > 1 THEN trim(string_split(t[2], chr(10))[1]) END AS title,
  CASE WHEN len(s) > 1 THEN trim(string_split(s[2], chr(10))[1]) END AS statement,
  CASE WHEN len(c) > 1 THEN replace(regexp_replace(c[2], '^\s+|\s+$', '', 'g'), chr(10), '') END AS code_statement
FROM f""",
)
def p4(spark, sf):
    text = F.col("response")
    return view(spark, sf, "v_completions").select(
        "conv_id", "turn", tx.implementation_title(text).alias("title"),
        tx.implementation_statement(text).alias("statement"), tx.code_statement(text).alias("code_statement"),
    )


@query(
    "p5_quality_issues",
    with_views("v_completions")
    + r""", m AS (SELECT conv_id, turn,
  regexp_extract_all(response, '\[(?:LOW|MEDIUM|HIGH)\] Line \d+(?:-\d+)?: .+', 0) AS e FROM v_completions)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(e, lambda x: NOT contains(
    regexp_extract(x, '^\[\w+\] Line [0-9-]+: (.+)$', 1), 'logger')),
  lambda x: 'priority: ' || regexp_extract(x, '^\[(\w+)\]', 1) || ', corrective action: '
    || regexp_extract(x, '^\[\w+\] Line [0-9-]+: (.+)$', 1)), chr(10)) AS issues
FROM m""",
)
def p5(spark, sf):
    return view(spark, sf, "v_completions").select("conv_id", "turn", tx.quality_summary(F.col("response")).alias("issues"))


@query(
    "p6_module_import",
    with_views("v_files")
    + """
SELECT file_id, CASE WHEN path LIKE '%.py' THEN 'from ' || replace(replace(path, '.py', ''), '/', '.')
  WHEN path LIKE '%.txt' THEN 'from ' || replace(replace(path, '.txt', ''), '/', '.')
  ELSE 'from ' || replace(path, '/', '.') END AS import_prefix FROM v_files""",
)
def p6(spark, sf):
    return view(spark, sf, "v_files").select("file_id", tx.module_import(F.col("path")).alias("import_prefix"))


@query(
    "p7_split_name",
    with_views("v_files")
    + """, b AS (SELECT file_id, string_split(path, '/')[-1] AS base FROM v_files)
SELECT file_id, base AS base_name, string_split(base, '.')[1] AS stem,
  CASE WHEN contains(base, '.') THEN '.' || string_split(base, '.')[2] ELSE '' END AS ext FROM b""",
)
def p7(spark, sf):
    path = F.col("path")
    return view(spark, sf, "v_files").select(
        "file_id", tx.base_name(path).alias("base_name"), tx.stem(path).alias("stem"), tx.extension(path).alias("ext")
    )


@query(
    "p8_size_budget",
    r"""
WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS l, len(regexp_extract_all(text, '\S+')) AS w,
  doc_id % 10 + 1 AS n, doc_id % 7 AS i FROM documents)
SELECT doc_id, CAST(l AS BIGINT) AS lines, CAST(w AS BIGINT) AS words,
  CAST(floor(l * CAST(1.1 AS DOUBLE) + l * CAST(0.5 AS DOUBLE) / n * i) AS BIGINT) AS line_budget,
  CAST(floor(w * CAST(1.2 AS DOUBLE) + w * CAST(0.5 AS DOUBLE) / n * i) AS BIGINT) AS word_budget
FROM c""",
)
def p8(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    sized = documents.select(
        "doc_id",
        budget.line_count(F.col("text")).cast("bigint").alias("lines"),
        budget.word_count(F.col("text")).cast("bigint").alias("words"),
    )
    n, i = F.col("doc_id") % 10 + 1, F.col("doc_id") % 7
    return sized.select(
        "*",
        budget.line_budget(F.col("lines"), n, i).alias("line_budget"),
        budget.word_budget(F.col("words"), n, i).alias("word_budget"),
    )


@query(
    "p9_temperature",
    """
SELECT event_id, round_even(least(2.0::DOUBLE, 2.0::DOUBLE / (user_id % 20 + 1) * (event_id % 25)), 2) AS temperature
FROM events""",
)
def p9(spark, sf):
    value = budget.temperature(F.col("user_id") % 20 + 1, F.col("event_id") % 25)
    return table(spark, sf, "events").select("event_id", value.alias("temperature"))


@query(
    "p10_run_label",
    """
SELECT o_orderkey, CASE WHEN o_orderkey < 26 THEN chr(CAST(65 + o_orderkey AS INT))
  WHEN o_orderkey < 702 THEN chr(CAST(64 + o_orderkey // 26 AS INT)) || chr(CAST(65 + o_orderkey % 26 AS INT))
  WHEN o_orderkey < 18278 THEN chr(CAST(65 + (o_orderkey - 702) // 676 AS INT))
    || chr(CAST(65 + ((o_orderkey - 26) // 26) % 26 AS INT)) || chr(CAST(65 + o_orderkey % 26 AS INT))
  ELSE chr(CAST(65 + (o_orderkey - 18278) // 17576 AS INT)) || chr(CAST(65 + ((o_orderkey - 702) // 676) % 26 AS INT))
    || chr(CAST(65 + ((o_orderkey - 26) // 26) % 26 AS INT)) || chr(CAST(65 + o_orderkey % 26 AS INT)) END AS label
FROM orders""",
)
def p10(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", budget.run_label(F.col("o_orderkey")).alias("label"))


@query(
    "p11_strip_placeholder_imports",
    with_views("v_completions")
    + r"""
SELECT conv_id, turn, regexp_replace(response, '(?m)^from your_module(.*?)\s*$', '', 'g') AS code,
  regexp_replace(response, '(?m)^from your_module import .*', '', 'g') AS code_names_only FROM v_completions""",
)
def p11(spark, sf):
    response = F.col("response")
    return view(spark, sf, "v_completions").select(
        "conv_id", "turn", tx.strip_placeholder_imports(response).alias("code"),
        tx.strip_placeholder_imports(response, names_only=True).alias("code_names_only"),
    )


@query(
    "p12_strip_comments",
    with_views("v_scripts")
    + r"""
SELECT path, CASE WHEN p_partkey % 97 <> 0 THEN
  regexp_replace(regexp_replace(text, '(?m)^# note [0-9]+$', '', 'g'), '# done', '') END AS code,
  p_partkey % 97 = 0 AS failed FROM v_scripts""",
)
def p12(spark, sf):
    scripts = view(spark, sf, "v_scripts").select("path", "text")
    cleaned = code_facts.strip_comments(scripts)
    return cleaned.select("path", "code", F.col("error").isNotNull().alias("failed"))


TEMPLATE = "Fix {line_count} lines ({word_count} words)\n{substitution_code_instruction}end {{ok}}"


@query(
    "p13_render_prompt",
    with_views("v_findings")
    + """
SELECT pos, 'system' AS role_first, 'Fix ' || CAST(line AS STRING) || ' lines (' || rule_id || ' words)' || chr(10)
  || message || 'end {ok}' AS content FROM v_findings""",
)
def p13(spark, sf):
    user = prompts.render_template(
        TEMPLATE,
        {
            "line_count": F.col("line"),
            "word_count": F.col("rule_id"),
            "substitution_code_instruction": F.col("message"),
        },
    )
    rows = view(spark, sf, "v_findings").select("pos", prompts.messages(F.lit("be brief"), user).alias("m"))
    return rows.select("pos", F.col("m")[0]["role"].alias("role_first"), F.col("m")[1]["content"].alias("content"))


def _format(name, sql, make):
    @query(name, with_views("v_findings") + f"\nSELECT pos, {sql} AS text FROM v_findings")
    def run(spark, sf):
        return view(spark, sf, "v_findings").select("pos", make().alias("text"))


_format(
    "p14a_format_bandit",
    "'- Test ID: ' || rule_id || ', Line: ' || CAST(line AS STRING) || ', Line Range: [' || CAST(line AS STRING) "
    "|| ', ' || CAST(line + 1 AS STRING) || '], Issue: ' || message",
    lambda: formats.bandit(
        F.col("rule_id"), F.col("line"), F.array(F.col("line"), F.col("line") + 1), F.col("message")
    ),
)
_format(
    "p14b_format_dodgy",
    "'- Line: ' || CAST(line AS STRING) || ', Variable: ' || rule_id || ', Reason: ' || message",
    lambda: formats.dodgy(F.col("line"), F.col("rule_id"), F.col("message")),
)
_format(
    "p14c_format_semgrep",
    "'  Line: ' || CAST(line AS STRING) || chr(10) || '  Message: ' || message || chr(10) || '  OWASP: ' "
    "|| CASE WHEN tag = '' THEN 'None' ELSE tag || ', A09' END || chr(10) || '  CWE: None' || chr(10)",
    lambda: formats.semgrep(
        F.col("line"),
        F.col("message"),
        F.when(F.col("tag") == "", F.array().cast("array<string>")).otherwise(F.array("tag", F.lit("A09"))),
        F.lit(None).cast("array<string>"),
    ),
)
_format(
    "p14d_format_mypy",
    "'Line: ' || CAST(line AS STRING) || chr(10) || chr(9) || 'Message: ' || message || chr(10)",
    lambda: formats.mypy(F.col("line"), F.col("message")),
)
_format(
    "p14e_format_vulture",
    "chr(9) || chr(9) || chr(9) || 'Type: ' || rule_id || ' --> Name: ' || message || chr(10)",
    lambda: formats.vulture(F.col("rule_id"), F.col("message")),
)


@query(
    "p15_parse_device_snapshot",
    SNAPSHOT_SQL
    + """SELECT device, count(*) AS samples, count(*) FILTER (power_draw < 0) AS unknown_power,
  max(temperature) AS max_temperature, max(memory_used) AS max_memory_used, max(gpu_utilization) AS max_utilization,
  CAST(sum(clocks_sm) AS DOUBLE) AS clock_sum FROM snapshots GROUP BY device""",
)
def p15(spark, sf):
    parsed = config.device_snapshots(view(spark, sf, "v_telemetry"))
    return parsed.groupBy("device").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("power_draw") < 0).alias("unknown_power"),
        F.max("temperature").alias("max_temperature"),
        F.max("memory_used").alias("max_memory_used"),
        F.max("gpu_utilization").alias("max_utilization"),
        F.sum("clocks_sm").alias("clock_sum"),
    )


@query(
    "p16_prepend_if_absent",
    with_views("v_sections")
    + """
SELECT pos, CASE WHEN position(arg IN code) > 0 OR position('return 1' IN code) > 0 THEN code
  ELSE 'return 1' || code END AS code FROM v_sections""",
)
def p16(spark, sf):
    code = tx.prepend_if_absent(F.col("code"), F.lit("return 1"))
    return view(spark, sf, "v_sections").select("pos", code.alias("code"))


@query(
    "p17_signature",
    with_views("v_sections")
    + """
SELECT pos, 'def ' || name || '(' || arg || ': ' || coalesce(arg_type, 'Any') || ', b: Any) -> '
  || coalesce(returns, 'Any') AS signature FROM v_sections""",
)
def p17(spark, sf):
    args = F.array(
        F.struct(F.col("arg").alias("name"), F.col("arg_type").alias("type")),
        F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type")),
    )
    text = tx.signature(F.col("name"), args, F.col("returns"))
    return view(spark, sf, "v_sections").select("pos", text.alias("signature"))


@query(
    "p18_test_outcome",
    with_views("v_completions")
    + """
SELECT conv_id, turn, NOT (stdout ILIKE '%fail%' OR stdout ILIKE '%error%' OR stderr ILIKE '%error%') AS passed
FROM v_completions""",
)
def p18(spark, sf):
    return view(spark, sf, "v_completions").select(
        "conv_id", "turn", tx.test_outcome(F.col("stdout"), F.col("stderr")).alias("passed")
    )


@query(
    "p19_main_block",
    COMBINED_SQL
    + """SELECT project, CAST(0 AS BIGINT) AS page, 'if __name__ == "__main__":' || chr(10) || '    '
  || string_agg(name || '()', chr(10) || '    ' ORDER BY first_file, first_pos) AS code FROM funcs GROUP BY project""",
)
def p19(spark, sf):
    functions, _ = combined(spark, sf)
    return sy.main_block(functions)


@query(
    "o3_first_match",
    with_views("v_completions")
    + r"""
SELECT conv_id, turn, regexp_extract(response, 'Line (\d+)', 1) AS first_line FROM v_completions""",
)
def o3(spark, sf):
    return view(spark, sf, "v_completions").select(
        "conv_id", "turn", F.regexp_extract("response", r"Line (\d+)", 1).alias("first_line")
    )
