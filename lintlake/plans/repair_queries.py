"""Queries over whole repairs of a corpus, with a completer and scanners made of expressions."""

from pyspark.sql import functions as F

from lintlake.functions import formats
from lintlake.operators import rules
from lintlake.plans import repair_loop
from lintlake.plans.catalog import query
from lintlake.plans.views import NL, table

ALLOWANCE = 5
# A section has up to seven weak calls, some a name without a type, some make the completer give up.
SECTIONS = {
    "path": "'src/o' || CAST(o_custkey % 300 AS STRING) || CASE WHEN o_custkey % 10 = 0 THEN '_unit_test' ELSE '' END || '.py'",
    "section": "'fn_' || CAST(o_orderkey AS STRING)",
    "code": f"'import base' || {NL} || 'x = ' || CAST(o_orderkey AS STRING) || {NL}"
    f" || repeat('weak(1)' || {NL}, CAST(o_orderkey % 8 AS INT))"
    f" || CASE WHEN o_orderkey % 7 = 0 THEN 'untyped = 1' || {NL} ELSE '' END"
    " || CASE WHEN o_orderkey % 11 = 0 THEN 'stubborn' ELSE 'easy' END",
}
RULES = (
    rules.LineRule("call", r"^weak\(", "Weak call", "weak("),
    rules.LineRule("name", r"^untyped ", "No type", "untyped "),
)
TEMPLATE = "{substitution_code_instruction}At most {line_count} lines."
GUIDANCE = {"weak(": "call the safe one"}


def scan(rows):
    """Weak calls are findings of a security scanner, missing types those of the type checker."""
    hits = rules.scan_lines(rows, RULES, list(repair_loop.ROUND), "code")
    typed = F.col("variable_name") == "name"
    text = F.when(typed, formats.mypy(F.col("line_number"), F.col("reason"))).otherwise(
        formats.dodgy(F.col("line_number"), F.col("variable_name"), F.col("reason"))
    )
    return hits.withColumns({"tool": F.when(typed, F.lit("mypy")).otherwise(F.lit("dodgy")), "text": text})


def complete(prompts):
    """Mends one place a time, notes the temperature and the findings of the prompt on the first line, and
    gives up on stubborn code once the temperature reaches 0.8."""
    # a column each, so that Spark makes each once
    rows = prompts.withColumn("user", F.col("messages")[1]["content"])
    rows = rows.withColumn("code", F.substring_index("user", "\n\n", -1))
    rows = rows.withColumn("body", F.regexp_extract("code", r"(?s)\A[^\n]*\n(.*)\z", 1))
    code, body = F.col("code"), F.col("body")
    issues = F.regexp_count("user", F.lit(r"- Line: |\tMessage: "))
    mended = F.when(body.contains("weak("), F.regexp_replace(body, r"(?s)\A(.*?)weak\(", "$1safe(")).otherwise(
        F.replace(body, F.lit("untyped "), F.lit("typed "))
    )
    block = F.concat(F.lit("# t "), F.col("temperature").cast("string"), F.lit(" n "), issues.cast("string"), F.lit("\n"), mended)
    gives_up = code.contains("stubborn") & (F.col("temperature") >= 0.8)
    response = F.when(gives_up, F.lit("I cannot help.")).otherwise(F.concat(F.lit("Done.\n```python\n"), block, F.lit("```")))
    return rows.withColumn("response", response).drop("user", "code", "body")


REPAIR_SQL = (
    "WITH RECURSIVE sections AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in SECTIONS.items())
    + f""" FROM orders)
, r AS (
  SELECT path, section, 0 AS iteration, CAST(NULL AS STRING) AS code_block, code AS fixed_code, FALSE AS passed, FALSE AS stops FROM sections
  UNION ALL
  SELECT path, section, iteration + 1, block, 'import auto' || {NL} || block, coalesce(clean, FALSE),
    block IS NULL OR clean OR iteration + 1 >= {ALLOWANCE}
  FROM (
    SELECT *, NOT contains(block, 'untyped ') AND (NOT contains(block, 'weak(') OR contains(path, 'unit_test')) AS clean FROM (
      SELECT path, section, iteration, CASE WHEN contains(fixed_code, 'stubborn') AND t >= 0.8 THEN NULL ELSE
        '# t ' || CAST(t AS STRING) || ' n ' || CAST(n AS STRING) || {NL}
        || CASE WHEN contains(body, 'weak(') THEN regexp_replace(body, 'weak\\(', 'safe(') ELSE replace(body, 'untyped ', 'typed ') END END AS block
      FROM (
        SELECT *, round(least(2.0::DOUBLE, 2.0::DOUBLE / {ALLOWANCE} * iteration), 2) AS t,
          substr(fixed_code, strpos(fixed_code, {NL}) + 1) AS body,
          CASE WHEN contains(path, 'unit_test') THEN 0 ELSE len(regexp_extract_all(fixed_code, 'weak\\(')) END
          + len(regexp_extract_all(fixed_code, 'untyped ')) AS n
        FROM r WHERE NOT stops))))
"""
)


def repaired(spark, sf):
    sections = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in SECTIONS.items()])
    fix = lambda block: F.concat(F.lit("import auto\n"), block)
    return repair_loop.repair_corpus(sections, scan, complete, TEMPLATE, "be brief", GUIDANCE, ALLOWANCE, fix)


@query(
    "e1_repair_loop",
    REPAIR_SQL
    + """SELECT path, section, iteration, CASE WHEN code_block IS NULL THEN NULL WHEN passed THEN fixed_code ELSE code_block END AS code,
  passed, CASE WHEN code_block IS NULL THEN 'no_code' WHEN passed THEN 'passed' ELSE 'spent' END AS status FROM r WHERE stops""",
)
def e1(spark, sf):
    """Where each section ended."""
    return repaired(spark, sf).resolved


@query("e1_repair_attempts", REPAIR_SQL + "SELECT path, section, iteration, code_block, CASE WHEN code_block IS NOT NULL THEN fixed_code END AS fixed_code, passed FROM r WHERE iteration > 0")
def e1_attempts(spark, sf):
    """Every attempt of every round."""
    return repaired(spark, sf).attempts.drop("libraries")
