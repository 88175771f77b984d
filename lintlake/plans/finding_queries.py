"""Queries over findings: de-duplication, roll-up, verdicts, comparisons, set operations."""

from pyspark.sql import functions as F

from lintlake.functions import formats
from lintlake.operators import findings as fi
from lintlake.plans.catalog import query
from lintlake.plans.views import view, with_views

V = with_views("v_findings")


def found(spark, sf):
    return view(spark, sf, "v_findings")


def rendered(rows):
    """Each finding in its tool's wording."""
    line, rule, message = F.col("line"), F.col("rule_id"), F.col("message")
    tags = F.when(F.col("tag") == "", F.array().cast("array<string>")).otherwise(F.array("tag"))
    text = (
        F.when(F.col("tool") == "bandit", formats.bandit(rule, line, F.array("line"), message))
        .when(F.col("tool") == "dodgy", formats.dodgy(line, rule, message))
        .when(F.col("tool") == "semgrep", formats.semgrep(line, message, tags, F.array().cast("array<string>")))
        .when(F.col("tool") == "mypy", formats.mypy(line, message))
        .otherwise(formats.vulture(rule, message))
    )
    return rows.withColumn("text", text)


RENDERED_SQL = """, rendered AS (SELECT *, CASE tool
  WHEN 'bandit' THEN '- Test ID: ' || rule_id || ', Line: ' || CAST(line AS STRING) || ', Line Range: ['
    || CAST(line AS STRING) || '], Issue: ' || message
  WHEN 'dodgy' THEN '- Line: ' || CAST(line AS STRING) || ', Variable: ' || rule_id || ', Reason: ' || message
  WHEN 'semgrep' THEN '  Line: ' || CAST(line AS STRING) || chr(10) || '  Message: ' || message || chr(10)
    || '  OWASP: ' || CASE WHEN tag = '' THEN 'None' ELSE tag END || chr(10) || '  CWE: None' || chr(10)
  WHEN 'mypy' THEN 'Line: ' || CAST(line AS STRING) || chr(10) || chr(9) || 'Message: ' || message || chr(10)
  ELSE chr(9) || chr(9) || chr(9) || 'Type: ' || rule_id || ' --> Name: ' || message || chr(10) END AS text
  FROM v_findings)
"""
GATED_SQL = """, gated AS (SELECT * FROM rendered
  WHERE NOT (position('unit_test' IN path) > 0 AND tool IN ('bandit', 'dodgy', 'semgrep')))
"""
FILES_SQL = """, files AS (SELECT DISTINCT path FROM v_findings)
, grid AS (SELECT path, unnest(['bandit', 'dodgy', 'semgrep', 'mypy']) AS tool FROM files)
"""
SUMMARY_SQL = """, pages AS (SELECT path, tool, CAST(0 AS BIGINT) AS page, string_agg(text, chr(10) ORDER BY pos) AS summary
  FROM gated GROUP BY path, tool)
, summaries AS (SELECT g.path, g.tool, coalesce(p.page, 0) AS page, coalesce(p.summary, 'No issues found.') AS summary
  FROM grid g LEFT JOIN pages p ON g.path = p.path AND g.tool = p.tool)
"""


def listed_files(spark, sf):
    return found(spark, sf).select("path").distinct()


def summary_rows(spark, sf):
    pages = fi.issue_pages(rendered(fi.gate_security_scans(found(spark, sf))))
    return fi.summaries(listed_files(spark, sf), pages)


@query(
    "a1_collapse_rules",
    V
    + """
SELECT path, rule_id, min(pos) AS pos, arg_max(line, pos) AS line, arg_max(message, pos) AS message
FROM v_findings GROUP BY path, rule_id""",
)
def a1(spark, sf):
    return fi.collapse_rules(found(spark, sf), rule="rule_id", details=("line", "message"))


@query(
    "a2_drop_duplicates",
    V
    + """
SELECT path, line, message, tag, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY path, line, message, tag ORDER BY pos) AS rn FROM v_findings)
WHERE rn = 1""",
)
def a2(spark, sf):
    return fi.drop_duplicate_findings(found(spark, sf), fields=("line", "message", "tag"))


@query("a3_issue_rollup", V + RENDERED_SQL + GATED_SQL + FILES_SQL + SUMMARY_SQL + "SELECT * FROM summaries")
def a3(spark, sf):
    return summary_rows(spark, sf)


@query(
    "a4_file_verdict",
    V
    + RENDERED_SQL
    + GATED_SQL
    + FILES_SQL
    + """, listed AS (SELECT path FROM files UNION ALL SELECT replace(path, 'corpus', 'clean') FROM files)
SELECT path, NOT EXISTS (SELECT 1 FROM gated g WHERE g.path = f.path AND g.tool <> 'vulture') AS passed FROM listed f""",
)
def a4(spark, sf):
    """Every reported file, and as many that nothing reports."""
    files = listed_files(spark, sf)
    clean = files.select(F.replace("path", F.lit("corpus"), F.lit("clean")).alias("path"))
    return fi.verdicts(files.unionByName(clean), fi.gate_security_scans(found(spark, sf)))


@query(
    "a11_finding_metrics",
    V
    + """
SELECT tool, path, rule_id, count(*) AS findings, CAST(grouping(tool, path, rule_id) AS BIGINT) AS level
FROM v_findings GROUP BY ROLLUP (tool, path, rule_id)""",
)
def a11(spark, sf):
    return fi.metrics(found(spark, sf))


@query(
    "f1_security_scan_gate",
    V
    + """
SELECT path, tool, pos FROM v_findings
WHERE path NOT LIKE '%unit!_test%' ESCAPE '!' OR tool IN ('mypy', 'vulture')""",
)
def f1(spark, sf):
    return fi.gate_security_scans(found(spark, sf)).select("path", "tool", "pos")


def _section_sql(tool: str) -> str:
    return (
        f"coalesce(chr(10) || '{tool.capitalize()} has identified the following issues in the provided Python code:' "
        f"|| chr(10) || max(summary) FILTER (tool = '{tool}' AND summary <> 'No issues found.') || chr(10) || chr(10), '')"
    )


SECTIONS_SQL = f""", parts AS (SELECT path, page, {_section_sql("bandit")} || {_section_sql("dodgy")}
    || {_section_sql("semgrep")} AS security, {_section_sql("mypy")} AS linter FROM summaries GROUP BY path, page)
, sections AS (SELECT path, page, regexp_replace(
  CASE WHEN security = '' THEN '' ELSE '**Adhere to Best Security Practices:**' || security END
  || chr(10) || chr(10) ||
  CASE WHEN linter = '' THEN '' ELSE '**Adhere to These Linter Findings:**' || linter END, '^\\s+|\\s+$', '', 'g')
  AS issues FROM parts)
"""


@query(
    "f3_issue_sections",
    V + RENDERED_SQL + GATED_SQL + FILES_SQL + SUMMARY_SQL + SECTIONS_SQL + "SELECT path, page, issues FROM sections",
)
def f3(spark, sf):
    return fi.issue_sections(summary_rows(spark, sf))


@query(
    "j12_corroborated",
    V
    + """
SELECT path, line, tool, pos FROM v_findings f WHERE (
  SELECT count(DISTINCT g.tool) FROM v_findings g WHERE g.path = f.path AND g.line = f.line) >= 2""",
)
def j12(spark, sf):
    return fi.corroborated(found(spark, sf)).select("path", "line", "tool", "pos")


@query(
    "j13_before_after",
    V
    + """, b AS (SELECT DISTINCT path, tool, rule_id, line FROM v_findings WHERE message IN ('message 0', 'message 1', 'message 3'))
, a AS (SELECT DISTINCT path, tool, rule_id, line + 1 AS line FROM v_findings WHERE message IN ('message 1', 'message 2', 'message 3'))
SELECT coalesce(b.path, a.path) AS path, coalesce(b.tool, a.tool) AS tool, coalesce(b.rule_id, a.rule_id) AS rule_id,
  coalesce(b.line, a.line) AS line,
  CASE WHEN a.path IS NULL THEN 'fixed' WHEN b.path IS NULL THEN 'new' ELSE 'kept' END AS status
FROM b FULL JOIN a ON b.path = a.path AND b.tool = a.tool AND b.rule_id = a.rule_id AND b.line = a.line""",
)
def j13(spark, sf):
    rows = found(spark, sf)
    before = rows.filter(F.col("message").isin("message 0", "message 1", "message 3"))
    after = rows.filter(F.col("message").isin("message 1", "message 2", "message 3")).withColumn("line", F.col("line") + 1)
    return fi.compare_attempts(before, after)


@query(
    "u1_union_rulesets",
    V
    + """, r AS (
  SELECT path, 0 AS ruleset_pos, pos, line, message, tag FROM v_findings
  UNION ALL SELECT path, 1, pos, line, CASE WHEN line < 50 THEN message ELSE 'other' END, tag FROM v_findings
  UNION ALL SELECT path, 2, pos, line, message, '' FROM v_findings)
SELECT path, line, message, tag, ruleset_pos, pos FROM (SELECT *, row_number() OVER (
  PARTITION BY path, line, message, tag ORDER BY ruleset_pos, pos) AS rn FROM r) WHERE rn = 1""",
)
def u1(spark, sf):
    base = found(spark, sf).select("path", "pos", "line", "message", F.array("tag").alias("owasp"), F.array().cast("array<string>").alias("cwe"))
    owasp = base.withColumn("message", F.when(F.col("line") < 50, F.col("message")).otherwise(F.lit("other")))
    python = base.withColumn("owasp", F.array(F.lit("")))
    rows = fi.union_rulesets([("p/default", base), ("p/owasp-top-ten", owasp), ("p/python", python)])
    return rows.select("path", "line", "message", F.col("owasp")[0].alias("tag"), "pos.ruleset_pos", "pos.pos")


@query(
    "u2_union_tools",
    V
    + """
SELECT path, run, tool, pos, CASE WHEN tool = 'bandit' THEN rule_id END AS rule_id, line, message,
  CASE tool WHEN 'bandit' THEN '[' || CAST(line AS STRING) || ']' WHEN 'dodgy' THEN rule_id
    WHEN 'semgrep' THEN tag END AS attr
FROM v_findings WHERE tool <> 'vulture'""",
)
def u2(spark, sf):
    rows = found(spark, sf)

    def of(tool, *columns):
        return rows.filter(F.col("tool") == tool).select("path", "run", "pos", *columns)

    together = fi.union_tools(
        {
            "bandit": of("bandit", F.col("rule_id").alias("test_id"), F.col("line").alias("line_number"),
                         F.array("line").alias("line_range"), F.col("message").alias("issue_text")),
            "dodgy": of("dodgy", F.col("line").alias("line_number"), F.col("rule_id").alias("variable_name"),
                        F.col("message").alias("reason")),
            "semgrep": of("semgrep", "line", "message", F.array("tag").alias("owasp")),
            "mypy": of("mypy", "line", "message"),
        }
    )
    attr = F.coalesce(F.col("attrs")["line_range"], F.col("attrs")["variable_name"], F.col("attrs")["owasp"])
    return together.select("path", "run", "tool", "pos", "rule_id", "line", "message", attr.alias("attr"))
