"""Queries over thousands of rules at once."""

from pyspark.sql import functions as F

from lintlake.operators import needles
from lintlake.operators.rules import LineRule
from lintlake.plans.catalog import query
from lintlake.plans.views import table, view, with_views

# Mailboxes by number and server, networks by their first two bytes: 10 604 rules.
MANY_RULES = [
    LineRule(f"mail{k}", rf"[a-z]\.{d:02d}@mail{k}\.example", f"Mailbox {d:02d}", f".{d:02d}@mail{k}.")
    for k in range(10)
    for d in range(100)
] + [
    LineRule(f"net{a}", rf"\b{a}\.{b}\.[0-9]+\.[0-9]+", f"Address in {a}.{b}", f"{a}.{b}.")
    for a in range(1, 224)
    for b in range(0, 256, 6)
]

MANY_RULES_SQL = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
, e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_number FROM l)
, rules AS (SELECT k * 100 + d AS i, '.' || lpad(CAST(d AS STRING), 2, '0') || '@mail' || k || '.' AS needle,
    '[a-z]\.' || lpad(CAST(d AS STRING), 2, '0') || '@mail' || k || '\.example' AS pattern,
    'mail' || k AS variable_name, 'Mailbox ' || lpad(CAST(d AS STRING), 2, '0') AS reason
  FROM range(10) x(k), range(100) y(d)
  UNION ALL SELECT 1000 + a * 43 + b // 6, a || '.' || b || '.', '\b' || a || '\.' || b || '\.[0-9]+\.[0-9]+',
    'net' || a, 'Address in ' || a || '.' || b FROM range(1, 224) x(a), range(0, 256, 6) y(b))
, hits AS (SELECT doc_id, line_number, i, variable_name, reason FROM e JOIN rules ON contains(line, needle)
  WHERE regexp_matches(line, pattern))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_number, i) - 1 AS pos, line_number, variable_name, reason
FROM hits"""


@query("j9_scan_many_rules", MANY_RULES_SQL)
def scan_many(spark, sf):
    """Every document against 10 604 rules."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    hits = needles.scan_many_rules(documents, MANY_RULES, ["doc_id"])
    return hits.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "line_number")})


# Statements of the code view, and a call of each number, most of which never occur.
MANY_GUIDANCE = {"import flask\n": "never", "django": "set config", "os": "stay in process", "(cmd)\nd": "check the command"} | {
    f"run{n}(cmd)": f"use form {n}" for n in range(5000)
} | {"": "read the code", ".run(cmd)\n@route\n\t# first": "name the route"}


@query(
    "j1_guidance_many",
    with_views("v_code")
    + r""", g AS (SELECT * FROM (VALUES (1, 'django', 'set config'), (2, 'os', 'stay in process'),
    (0, 'import flask' || chr(10), 'never'), (3, '(cmd)' || chr(10) || 'd', 'check the command'), (5004, '', 'read the code'),
    (5005, '.run(cmd)' || chr(10) || '@route' || chr(10) || chr(9) || '# first', 'name the route')) v(i, needle, advice)
  UNION ALL SELECT 4 + n, 'run' || n || '(cmd)', 'use form ' || n FROM range(5000) r(n))
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS pos, needle, advice
FROM v_code JOIN g ON contains(code, needle)""",
)
def match_many(spark, sf):
    """Every piece of code against 5 006 entries of guidance."""
    found = needles.match_many(view(spark, sf, "v_code"), MANY_GUIDANCE, ["file_id"])
    return found.withColumn("pos", F.col("pos").cast("bigint"))
