"""Queries over repair attempts and prompts."""

from pyspark.sql import functions as F

from lintlake.operators import alignment
from lintlake.operators import attempts as at
from lintlake.operators import findings as fi
from lintlake.operators import prompts
from lintlake.plans.catalog import query
from lintlake.plans.source_queries import ATTEMPTS_SQL, attempts
from lintlake.plans.text_queries import libs_sql
from lintlake.plans.views import table, view, with_views

ALLOWANCE = 20


@query(
    "w1_resolve_attempts",
    ATTEMPTS_SQL
    + f""", s AS (SELECT *, row_number() OVER (PARTITION BY path, section ORDER BY iteration) AS rn FROM attempts
  WHERE passed OR code_block IS NULL OR iteration >= {ALLOWANCE})
, k AS (SELECT DISTINCT path, section FROM attempts)
SELECT k.path, k.section, s.iteration,
  CASE WHEN s.code_block IS NULL THEN NULL WHEN s.passed THEN s.fixed_code ELSE s.code_block END AS code,
  coalesce(s.passed AND s.code_block IS NOT NULL, FALSE) AS passed,
  CASE WHEN s.rn IS NULL THEN 'open' WHEN s.code_block IS NULL THEN 'no_code' WHEN s.passed THEN 'passed'
    ELSE 'spent' END AS status
FROM k LEFT JOIN s ON s.path = k.path AND s.section = k.section AND s.rn = 1""",
)
def w1(spark, sf):
    return at.resolve(attempts(spark, sf), ALLOWANCE)


@query(
    "w2_iteration_schedule",
    r"""
WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS l, len(regexp_extract_all(text, '\S+')) AS w FROM documents)
, r AS (SELECT doc_id, l, w, unnest(range(5)) AS i FROM c)
SELECT doc_id, CAST(i AS BIGINT) AS iteration,
  CAST(floor(l * CAST(1.1 AS DOUBLE) + l * CAST(0.5 AS DOUBLE) / 5 * i) AS BIGINT) AS line_count,
  CAST(floor(w * CAST(1.2 AS DOUBLE) + w * CAST(0.5 AS DOUBLE) / 5 * i) AS BIGINT) AS word_count,
  round_even(2.0::DOUBLE / 5 * i, 2) AS temperature FROM r""",
)
def w2(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    rows = at.schedule(documents, 5, ["doc_id"])
    return rows.withColumn("iteration", F.col("iteration").cast("bigint"))


@query(
    "w3_carried_libraries",
    ATTEMPTS_SQL
    + f""", l AS (SELECT path, section, iteration, {libs_sql("coalesce(fixed_code, '')")} AS libs FROM attempts)
SELECT path, section, iteration, array_to_string(coalesce(
  lag(libs) OVER (PARTITION BY path, section ORDER BY iteration), ['origin_' || path]), ',') AS libraries FROM l""",
)
def w3(spark, sf):
    rows = attempts(spark, sf)
    first = F.concat(F.lit("import origin_"), "path").alias("code")
    carried = at.carried_libraries(rows, rows.select("path", "section").distinct().select("path", "section", first))
    return carried.withColumn("libraries", F.array_join("libraries", ","))


@query(
    "w5_resolve_tests",
    ATTEMPTS_SQL
    + """, r AS (SELECT *, NOT (stdout ILIKE '%fail%' OR stdout ILIKE '%error%' OR stderr ILIKE '%error%')
  AND iteration <= 3 AS ok FROM attempts)
SELECT path, section, min(iteration) FILTER (ok) AS runs,
  CASE WHEN bool_or(ok) THEN arg_min(fixed_code, iteration) END AS code FROM r GROUP BY path, section""",
)
def w5(spark, sf):
    runs = attempts(spark, sf).withColumn("original", F.col("fixed_code"))
    return at.resolve_tests(runs, 3)


@query(
    "a14_run_labels",
    with_views("v_attempts")
    + """, n AS (SELECT section, count(DISTINCT run) AS earlier_runs FROM v_attempts GROUP BY section)
SELECT section, earlier_runs, CASE WHEN earlier_runs >= 702 THEN chr(CAST(65 + (earlier_runs - 702) // 676 AS INT))
    || chr(CAST(65 + ((earlier_runs - 26) // 26) % 26 AS INT))
  WHEN earlier_runs >= 26 THEN chr(CAST(64 + earlier_runs // 26 AS INT)) ELSE '' END
  || chr(CAST(65 + earlier_runs % 26 AS INT)) AS label FROM n""",
)
def a14(spark, sf):
    return at.run_labels(view(spark, sf, "v_attempts"), "section", "run")


# Findings of attempt i of a section, from the same events as the attempts.
ISSUES_SQL = """, af AS (SELECT 'p' || CAST(user_id % 7 AS STRING) AS path, 'fn_' || CAST(user_id AS STRING) AS section,
    1 + event_id % 40 AS iteration, event_id AS pos,
    'Line: ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || chr(9) || 'Message: ' || event_type || chr(10) AS t FROM events)
, issues AS (SELECT path, section, iteration, CAST(0 AS BIGINT) AS page,
    '**Adhere to These Linter Findings:**' || chr(10) || 'Mypy has identified the following issues in the provided Python code:'
    || chr(10) || regexp_replace(string_agg(t, chr(10) ORDER BY pos), '\\s+$', '') AS issues FROM af GROUP BY path, section, iteration)
, joined AS (SELECT a.path, a.section, a.iteration, coalesce(i.page, 0) AS page, coalesce(i.issues, '') AS issues,
    a.fixed_code FROM attempts a LEFT JOIN issues i ON i.path = a.path AND i.section = a.section AND i.iteration = a.iteration)
"""


def issue_rows(spark, sf):
    from lintlake.functions import formats
    from lintlake.plans.views import K_TEXT

    rows = table(spark, sf, "events").selectExpr(
        "'p' || CAST(user_id % 7 AS STRING) AS path",
        "'fn_' || CAST(user_id AS STRING) AS section",
        "1 + event_id % 40 AS iteration",
        "event_id AS pos",
        "'mypy' AS tool",
        f"{K_TEXT} AS line",
        "event_type AS message",
    )
    keys = ["path", "section", "iteration"]
    pages = fi.issue_pages(
        rows.withColumn("text", formats.mypy(F.col("line"), F.col("message"))), [*keys, "tool"]
    )
    return fi.issue_sections(pages, keys)


@query(
    "j11_attempt_findings",
    ATTEMPTS_SQL + ISSUES_SQL + "SELECT path, section, iteration, page, issues FROM joined",
)
def j11(spark, sf):
    rows = attempts(spark, sf).select("path", "section", "iteration")
    return prompts.attempt_findings(rows, issue_rows(spark, sf), ["path", "section"])


TEMPLATE = "{substitution_code_instruction}Keep to {word_count} words or {line_count} lines."
GUIDANCE = {"fixed": "pin it", "absent": "never"}


@query(
    "p13_prompt_rows",
    ATTEMPTS_SQL
    + ISSUES_SQL
    + f"""SELECT path, section, iteration, page, round_even(least(2.0::DOUBLE, 2.0::DOUBLE / {ALLOWANCE} * iteration), 2) AS temperature,
  trim(CASE WHEN issues = '' THEN '' ELSE issues || chr(10) || chr(10) END
  || 'Please modify the code below strictly according to the provided instructions. Address only the '
  || 'specific issues mentioned in the following substitution statements as they pertain to the code below,'
  || ' without adding or assuming anything beyond what is explicitly stated:' || chr(10)
  || chr(9) || '* For ''fixed'', pin it' || chr(10) || 'Keep to '
  || CAST(CAST(floor(5 * CAST(1.2 AS DOUBLE) + 5 * CAST(0.5 AS DOUBLE) / {ALLOWANCE} * iteration) AS BIGINT) AS STRING) || ' words or '
  || CAST(CAST(floor(2 * CAST(1.1 AS DOUBLE) + 2 * CAST(0.5 AS DOUBLE) / {ALLOWANCE} * iteration) AS BIGINT) AS STRING) || ' lines.')
  || chr(10) || chr(10) || fixed_code AS user_prompt
FROM joined WHERE iteration < {ALLOWANCE}""",
)
def p13_rows(spark, sf):
    """Whole prompts: attempts, their findings, the original's size, guidance, template."""
    rows = attempts(spark, sf).select("path", "section", "iteration", F.col("fixed_code").alias("code"))
    originals = rows.filter(F.col("iteration") == 1).select("path", "section", "code")
    made = prompts.prompt_rows(
        rows, issue_rows(spark, sf), originals, TEMPLATE, "be brief", GUIDANCE, ALLOWANCE, ["path", "section"]
    )
    user = F.col("messages")[1]["content"]
    return made.select("path", "section", "iteration", "page", "temperature", user.alias("user_prompt"))


@query(
    "j13_first_last_attempt",
    ATTEMPTS_SQL
    + """, ends AS (SELECT path, section, min(iteration) AS f, max(iteration) AS l FROM attempts GROUP BY path, section)
, found AS (SELECT path, section, unnest([iteration, iteration + 3]) AS iteration, event_id % 5 AS line FROM attempts)
, b AS (SELECT DISTINCT path, section, line FROM found JOIN ends USING (path, section) WHERE iteration = f)
, a AS (SELECT DISTINCT path, section, line FROM found JOIN ends USING (path, section) WHERE iteration = l)
SELECT coalesce(a.path, b.path) AS path, coalesce(a.section, b.section) AS section, coalesce(a.line, b.line) AS line,
  CASE WHEN a.path IS NULL THEN 'fixed' WHEN b.path IS NULL THEN 'new' ELSE 'kept' END AS status
FROM a FULL JOIN b ON a.path = b.path AND a.section = b.section AND a.line = b.line""",
)
def j13_ends(spark, sf):
    rows = attempts(spark, sf)
    iterations = F.explode(F.array("iteration", F.col("iteration") + 3)).alias("iteration")
    findings = rows.select("path", "section", iterations, (F.col("event_id") % 5).alias("line"))
    return fi.compare_first_last(rows, findings, identity=("line",))


# The last attempt of a section is the first one with a line on top, its end moved up, and one place mended.
VERSIONS = {
    "path": "'src/o' || CAST(o_custkey % 300 AS STRING) || '.py'",
    "section": "'fn_' || CAST(o_orderkey AS STRING)",
    "old": "'import base' || chr(10) || 'a = ' || CAST(o_orderkey AS STRING) || chr(10) || 'pass' || chr(10) || 'weak(1)'"
    " || chr(10) || 'b = 2' || chr(10) || 'weak(2)' || chr(10) || 'end'",
    "new": "CASE WHEN o_orderkey % 3 = 0 THEN '# note' || chr(10) ELSE '' END || 'b = 2' || chr(10) || 'weak(2)' || chr(10) || 'end' || chr(10)"
    " || 'import base' || chr(10) || 'a = ' || CAST(o_orderkey AS STRING) || chr(10) || 'pass' || chr(10)"
    " || CASE WHEN o_orderkey % 2 = 0 THEN 'safe(1)' ELSE 'weak(1)' END || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'weak(3)' ELSE '' END",
}
MOVED_SQL = (
    "WITH v AS (SELECT o_orderkey % 2 AS m, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS up, o_orderkey % 5 AS more, "
    + ", ".join(f"{VERSIONS[c]} AS {c}" for c in ("path", "section"))
    + """ FROM orders)
SELECT path, section, 'weak' AS rule_id, CAST(6 AS BIGINT) AS line, CAST(2 + up AS BIGINT) AS "to", 'kept' AS status FROM v
UNION ALL SELECT path, section, 'weak', 4, CASE WHEN m = 0 THEN NULL ELSE 7 + up END, CASE WHEN m = 0 THEN 'fixed' ELSE 'kept' END FROM v
UNION ALL SELECT path, section, 'weak', NULL, 8 + up, 'new' FROM v WHERE more = 0"""
)


@query("j13_moved_findings", MOVED_SQL)
def j13_moved(spark, sf):
    """Findings of two versions of each section, compared by the line that each line became."""
    keys = ["path", "section"]
    versions = table(spark, sf, "orders").selectExpr(*[f"{e} AS `{c}`" for c, e in VERSIONS.items()])
    before, after = (alignment.lines_of(versions, keys, c) for c in ("old", "new"))
    weak = lambda df: df.where("content LIKE 'weak(%'").select(*keys, F.lit("weak").alias("rule_id"), "line")
    return alignment.compare_moved(weak(before), weak(after), alignment.moved_lines(before, after, keys), keys, ["rule_id"])
