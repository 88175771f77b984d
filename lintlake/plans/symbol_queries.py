"""Queries over symbol relations, on fixture symbols and on facts parsed from generated scripts."""

from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import code_facts as cf
from lintlake.operators import rules
from lintlake.operators import symbols as sy
from lintlake.operators.paging import sorted_positions
from lintlake.plans import repair
from lintlake.plans.catalog import query
from lintlake.plans.source_queries import COMBINED_SQL, METHODS_SQL, combined
from lintlake.plans.text_queries import libs_sql
from lintlake.plans.views import view, with_views

GLOBALS_SQL = """, globals AS (SELECT path, name, arg_max(code, pos) AS code, min(pos) AS pos
  FROM v_assigns GROUP BY path, name)
, used AS (SELECT DISTINCT path, scope, name FROM v_refs)
"""
SYMBOLS = with_views("v_assigns", "v_refs", "v_imports", "v_methods")

GUIDANCE = {"os.system": "use native calls", "subprocess": "stay in process", "pickle": "use json", "flask": "set config"}


# -- joins -----------------------------------------------------------------------


@query(
    "j1_guidance_match",
    with_views("v_code")
    + """, s AS (SELECT file_id, list_filter([
    CASE WHEN contains(code, 'os.system') THEN chr(9) || '* For ''os.system'', use native calls' END,
    CASE WHEN contains(code, 'subprocess') THEN chr(9) || '* For ''subprocess'', stay in process' END,
    CASE WHEN contains(code, 'pickle') THEN chr(9) || '* For ''pickle'', use json' END,
    CASE WHEN contains(code, 'flask') THEN chr(9) || '* For ''flask'', set config' END], lambda x: x IS NOT NULL) AS l
  FROM v_code)
SELECT file_id, array_to_string(l, chr(10)) AS statements, len(l) = 0 AS no_instruction FROM s""",
)
def j1(spark, sf):
    code = F.col("code")
    return view(spark, sf, "v_code").select(
        "file_id",
        F.array_join(rules.matched_guidance(code, GUIDANCE), "\n").alias("statements"),
        (rules.substitution_instruction(code, GUIDANCE) == "").alias("no_instruction"),
    )


@query(
    "j2_rulesets",
    with_views("v_code")
    + f""", l AS (SELECT file_id, path, {libs_sql("code")} AS libs FROM v_code)
SELECT path, ruleset FROM l, (VALUES ('p/default'), ('p/owasp-top-ten'), ('p/python')) b(ruleset)
UNION ALL SELECT path, 'p/django' FROM l WHERE list_contains(libs, 'django')
UNION ALL SELECT path, 'p/flask' FROM l WHERE list_contains(libs, 'flask')""",
)
def j2(spark, sf):
    return rules.file_rulesets(view(spark, sf, "v_code"), ["path"]).select("path", "ruleset")


@query(
    "j3_global_uses",
    SYMBOLS + GLOBALS_SQL + "SELECT u.path, u.scope, u.name, g.pos, g.code FROM used u JOIN globals g USING (path, name)",
)
def j3(spark, sf):
    return sy.global_uses(view(spark, sf, "v_assigns"), view(spark, sf, "v_refs"))


@query(
    "j4_import_uses",
    SYMBOLS
    + GLOBALS_SQL
    + "SELECT u.path, u.scope, i.name, i.pos, i.code FROM used u JOIN v_imports i ON i.path = u.path AND i.name = u.name",
)
def j4(spark, sf):
    return sy.import_uses(view(spark, sf, "v_imports"), view(spark, sf, "v_refs")).drop("alias_pos")


# Functions use names; the main block counts for instances only.
USED_SQL = """, used_globals AS (SELECT path, name FROM v_refs WHERE scope <> '__main__'
  UNION SELECT r.path, r.name FROM v_refs r WHERE r.scope = '__main__' AND EXISTS (
    SELECT 1 FROM v_assigns a WHERE a.path = r.path AND a.name = r.name AND a.call_class IS NOT NULL))
"""


@query(
    "j5_unused_globals",
    SYMBOLS
    + GLOBALS_SQL
    + USED_SQL
    + "SELECT path, name, pos, code FROM globals g WHERE NOT EXISTS (SELECT 1 FROM used_globals u WHERE u.path = g.path AND u.name = g.name)",
)
def j5(spark, sf):
    return sy.unused_globals(view(spark, sf, "v_assigns"), view(spark, sf, "v_refs"))


UNUSED_IMPORTS_SQL = """SELECT path, pos, code FROM v_imports i WHERE NOT EXISTS (
  SELECT 1 FROM v_imports j JOIN v_refs r ON r.path = j.path AND r.name = j.name AND r.scope <> '__main__'
  WHERE j.path = i.path AND j.code = i.code)"""


@query("j5_unused_imports", SYMBOLS + UNUSED_IMPORTS_SQL)
def j5_imports(spark, sf):
    return sy.unused_imports(view(spark, sf, "v_imports"), view(spark, sf, "v_refs"))


@query(
    "j6_instance_uses",
    SYMBOLS
    + """, made AS (SELECT path, name, arg_max(code, pos) AS code, min(pos) FILTER (call_class IS NOT NULL) AS pos,
  arg_max(call_class, pos) FILTER (call_class IS NOT NULL) AS call_class
  FROM v_assigns GROUP BY path, name HAVING bool_or(call_class IS NOT NULL))
SELECT l.path, l.name, l.pos, l.code, l.call_class FROM made l
WHERE EXISTS (SELECT 1 FROM v_refs r WHERE r.path = l.path AND r.name = l.name AND r.scope = '__main__')""",
)
def j6(spark, sf):
    return sy.instance_uses(view(spark, sf, "v_assigns"), view(spark, sf, "v_refs"))


@query(
    "j7_test_plan",
    with_views("v_sections")
    + METHODS_SQL
    + """SELECT path, name, code, test_type, description FROM methods, (VALUES
  ('positive', '**Positive Test:** Verifies normal method behavior.'),
  ('negative', '**Negative Test:** Handles invalid input.'),
  ('boundary', '**Boundary Test:** Tests a special edge value.')) t(test_type, description) WHERE name <> 'main'""",
)
def j7(spark, sf):
    return sy.test_plan(sy.method_table(view(spark, sf, "v_sections")))


@query(
    "j8_method_imports",
    with_views("v_sections")
    + METHODS_SQL
    + """SELECT path, name, pos, 'from ' || replace(replace(path, '.py', ''), '/', '.') || ' import ' || name
  AS import_statement FROM methods WHERE name <> 'main'""",
)
def j8(spark, sf):
    rows = view(spark, sf, "v_sections")
    statement = F.concat(tx.module_import(F.col("path")), F.lit(" import "), "name").alias("import_statement")
    methods = sy.without_main(sy.method_table(rows)).select("path", "name", "pos")
    return sy.method_imports(methods, rows.select("path", "name", statement))


@query(
    "f2_without_main",
    with_views("v_sections") + "SELECT path, pos, name FROM v_sections EXCEPT SELECT path, pos, name FROM v_sections WHERE name = 'main'",
)
def f2(spark, sf):
    return sy.without_main(view(spark, sf, "v_sections")).select("path", "pos", "name")


@query(
    "f4_main_block",
    with_views("v_scripts")
    + """
SELECT path, 'if __name__ == "__main__":' || chr(10) || '    app.run()' AS code FROM v_scripts WHERE p_partkey % 97 <> 0""",
)
def f4(spark, sf):
    return cf.main_blocks(facts(spark, sf))


@query(
    "f5_assignment_kind",
    SYMBOLS
    + """
SELECT path, pos, name, CASE WHEN name LIKE 'CONST%' THEN 'constant' WHEN call_arg IS NOT NULL THEN 'instance'
  ELSE 'other' END AS kind FROM v_assigns""",
)
def f5(spark, sf):
    kind = sy.assignment_kind(F.col("name"), F.col("call_class"), F.col("call_arg"))
    return view(spark, sf, "v_assigns").select("path", "pos", "name", kind.alias("kind"))


# -- aggregations ------------------------------------------------------------------

MERGED_SQL = """, merged AS (
  SELECT DISTINCT path, module, CAST(0 AS BIGINT) AS page, 'import ' || name AS statement FROM v_imports WHERE module IS NULL
  UNION ALL SELECT path, module, 0, 'from ' || module || ' import ' || string_agg(DISTINCT name, ', ' ORDER BY name)
  FROM v_imports WHERE module IS NOT NULL GROUP BY path, module)
"""


@query("a5_merged_imports", SYMBOLS + MERGED_SQL + "SELECT * FROM merged")
def a5(spark, sf):
    return sy.merged_imports(view(spark, sf, "v_imports"))


def _group_sql() -> str:
    names = ", ".join(f"'{m}'" for m in sy.STANDARD_MODULES)
    return f""", std AS (SELECT unnest([{names}]) AS m)
, kinds AS (SELECT DISTINCT statement, CASE
  WHEN EXISTS (SELECT 1 FROM std WHERE starts_with(statement, 'import ' || m) OR starts_with(statement, 'from ' || m))
    THEN 'standard'
  WHEN statement LIKE 'from .%' OR statement LIKE 'import .%' THEN 'local' ELSE 'third_party' END AS import_group
  FROM (SELECT DISTINCT statement FROM merged))
"""


GROUPED_SQL = MERGED_SQL + _group_sql()


@query(
    "a6_import_groups",
    SYMBOLS
    + GROUPED_SQL
    + """SELECT path, import_group, CAST(0 AS BIGINT) AS page, string_agg(statement, chr(10) ORDER BY statement) AS statements
FROM merged JOIN kinds USING (statement) GROUP BY path, import_group""",
)
def a6(spark, sf):
    return sy.grouped_imports(sy.merged_imports(view(spark, sf, "v_imports")))


@query(
    "a7_import_map",
    SYMBOLS
    + """
SELECT path, module, CAST(0 AS BIGINT) AS page, string_agg(name, ', ' ORDER BY pos // 64, 63 - pos % 64) AS names
FROM v_imports WHERE module IS NOT NULL GROUP BY path, module
UNION ALL SELECT DISTINCT path, name, 0, '' FROM v_imports i WHERE module IS NULL
  AND NOT EXISTS (SELECT 1 FROM v_imports j WHERE j.path = i.path AND j.module = i.name)""",
)
def a7(spark, sf):
    """Statements of up to 64 aliases, whose order differs from that of the rows."""
    aliases = {"pos": F.expr("pos div 64"), "alias_pos": F.expr("63 - pos % 64")}
    return sy.import_map(view(spark, sf, "v_imports").withColumns(aliases))


@query("a8_combined_functions", COMBINED_SQL + "SELECT * FROM funcs")
def a8(spark, sf):
    return combined(spark, sf)[0]


@query("u3_combined_imports", COMBINED_SQL + "SELECT * FROM stmts")
def u3(spark, sf):
    return combined(spark, sf)[1]


@query("a9_method_table", with_views("v_sections") + METHODS_SQL + "SELECT * FROM methods")
def a9(spark, sf):
    return sy.method_table(view(spark, sf, "v_sections"))


@query("a10_global_table", SYMBOLS + GLOBALS_SQL + "SELECT path, name, pos, code FROM globals")
def a10(spark, sf):
    return sy.global_table(view(spark, sf, "v_assigns"))


@query(
    "a13_method_count",
    with_views("v_sections") + "SELECT path, count(DISTINCT name) AS methods FROM v_sections GROUP BY path",
)
def a13(spark, sf):
    return sy.method_counts(view(spark, sf, "v_sections"))


# -- order, difference ---------------------------------------------------------------


@query(
    "o1_methods_in_name_order",
    with_views("v_sections")
    + METHODS_SQL
    + "SELECT path, name, CAST(row_number() OVER (PARTITION BY path ORDER BY name) - 1 AS BIGINT) AS rank FROM methods",
)
def o1(spark, sf):
    table = sy.method_table(view(spark, sf, "v_sections")).select("path", "name")
    return sorted_positions(table, ["path"], ["name"])


@query(
    "o2_sorted_imports",
    COMBINED_SQL
    + """SELECT project, statement, CAST(row_number() OVER (PARTITION BY project ORDER BY statement) - 1 AS BIGINT) AS rank
FROM stmts""",
)
def o2(spark, sf):
    return sorted_positions(combined(spark, sf)[1], ["project"], ["statement"])


@query(
    "u4_unused_names",
    SYMBOLS + USED_SQL + "SELECT path, name FROM v_assigns EXCEPT SELECT path, name FROM used_globals",
)
def u4(spark, sf):
    """All names minus used names."""
    assigns = view(spark, sf, "v_assigns")
    return assigns.select("path", "name").subtract(sy.used_globals(assigns, view(spark, sf, "v_refs")))


# -- facts from code ------------------------------------------------------------------

PARSED = with_views("v_scripts") + """, ok AS (SELECT * FROM v_scripts WHERE p_partkey % 97 <> 0)
"""
IMPORT_FACTS_SQL = """, import_facts AS (
  SELECT path, NULL AS module, 'os' AS name, NULL AS alias, 'import os' AS code FROM ok
  UNION ALL SELECT path, 'flask', 'Flask', NULL, 'from flask import Flask, request as rq' FROM ok
  UNION ALL SELECT path, 'flask', 'request', 'rq', 'from flask import Flask, request as rq' FROM ok
  UNION ALL SELECT path, 'util', 'helper', NULL, 'from .util import helper' FROM ok WHERE p_size % 4 = 0)
"""


def scripts(spark, sf):
    return view(spark, sf, "v_scripts").select("path", "text")


def facts(spark, sf):
    return cf.symbol_facts(scripts(spark, sf))


@query(
    "x1_symbol_facts",
    PARSED
    + IMPORT_FACTS_SQL
    + """, f AS (
  SELECT path, 'error' AS kind, '' AS scope, '' AS name FROM v_scripts WHERE p_partkey % 97 = 0
  UNION ALL SELECT path, 'import', '', name FROM import_facts
  UNION ALL SELECT path, 'assign', '', 'LIMIT' FROM ok
  UNION ALL SELECT path, 'assign', '', 'app' FROM ok WHERE p_size % 3 = 0
  UNION ALL SELECT path, 'assign', '', 'items' FROM ok WHERE p_size % 5 = 0
  UNION ALL SELECT path, 'def', '', 'run_' || CAST(p_partkey % 5 AS STRING) FROM ok
  UNION ALL SELECT path, 'def', 'Box.', 'size' FROM ok WHERE p_partkey % 4 = 0
  UNION ALL SELECT path, 'ref', 'run_' || CAST(p_partkey % 5 AS STRING), unnest(['LIMIT', 'a', 'int', 'os', 'str']) FROM ok
  UNION ALL SELECT path, 'ref', 'run_' || CAST(p_partkey % 5 AS STRING), 'route' FROM ok WHERE p_partkey % 3 = 0
  UNION ALL SELECT path, 'ref', '__main__', unnest(['__name__', 'app']) FROM ok
  UNION ALL SELECT path, 'main', '__main__', '' FROM ok
  UNION ALL SELECT path, 'statement', '', unnest(['FunctionDef', 'If']) FROM ok
  UNION ALL SELECT path, 'statement', '', 'ClassDef' FROM ok WHERE p_partkey % 4 = 0)
SELECT * FROM f""",
)
def x1(spark, sf):
    return facts(spark, sf).select("path", "kind", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("name", F.lit("")).alias("name"))


@query(
    "x2_function_names",
    PARSED
    + """SELECT path, 'run_' || CAST(p_partkey % 5 AS STRING) AS name,
  'def run_' || CAST(p_partkey % 5 AS STRING) || '(a: int, b: Any) -> str' AS signature FROM ok
UNION ALL SELECT path, 'size', 'def size(self: Any) -> Any' FROM ok WHERE p_partkey % 4 = 0""",
)
def x2(spark, sf):
    signature = tx.signature(F.col("name"), F.col("args"), F.col("returns"))
    return cf.functions(facts(spark, sf)).select("path", "name", signature.alias("signature"))


@query(
    "w4_leading_blocks",
    with_views("v_code")
    + r""", l AS (SELECT file_id, string_split(code, chr(10)) AS a FROM v_code)
, e AS (SELECT file_id, unnest(a) AS line_text, generate_subscripts(a, 1) AS n FROM l)
, m AS (SELECT *, coalesce(max(CASE WHEN NOT regexp_matches(line_text, '^\s*[@#]') THEN n END)
    OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_plain FROM e)
, d AS (SELECT file_id, n, last_plain, regexp_extract(line_text, '^def\s+(\w+)', 1) AS name FROM m
  WHERE regexp_matches(line_text, '^def\s+\w+') AND last_plain < n - 1)
SELECT d.file_id, CAST(d.n AS BIGINT) AS line, d.name, string_agg(trim(e.line_text, ' ' || chr(9)), chr(10) ORDER BY e.n) AS block
FROM d JOIN e ON e.file_id = d.file_id AND e.n > d.last_plain AND e.n < d.n GROUP BY d.file_id, d.n, d.name""",
)
def w4(spark, sf):
    found = cf.leading_lines(view(spark, sf, "v_code"), ["file_id"], "code")
    return found.withColumn("line", F.col("line").cast("bigint"))


@query(
    "x3_method_slices",
    SYMBOLS
    + GLOBALS_SQL
    + """, methods AS (SELECT path, name, arg_max(code, pos) AS code FROM v_methods GROUP BY path, name)
, pieces AS (
  SELECT u.path, u.scope AS name, 0 AS part, -i.pos AS up, i.code FROM used u
    JOIN v_imports i ON i.path = u.path AND i.name = u.name
  UNION ALL SELECT u.path, u.scope, 1, -g.pos, g.code FROM used u JOIN globals g ON g.path = u.path AND g.name = u.name
  UNION ALL SELECT path, name, 3, 0, code FROM methods)
SELECT p.path, p.name, CAST(0 AS BIGINT) AS page, string_agg(p.code, chr(10) ORDER BY part, up) AS code
FROM pieces p JOIN methods m ON m.path = p.path AND m.name = p.name GROUP BY p.path, p.name""",
)
def x3(spark, sf):
    return sy.method_slices(
        view(spark, sf, "v_methods"), view(spark, sf, "v_assigns"), view(spark, sf, "v_imports"), view(spark, sf, "v_refs")
    )


@query(
    "x3_parsed_method_slices",
    PARSED
    + """SELECT path, 'run_' || CAST(p_partkey % 5 AS STRING) AS name, CAST(0 AS BIGINT) AS page,
  'import os' || chr(10) || 'LIMIT = ' || CAST(p_size AS STRING) || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '# note ' || CAST(p_partkey AS STRING) || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN '@route' || chr(10) ELSE '' END
  || 'def run_' || CAST(p_partkey % 5 AS STRING) || '(a: int, b) -> str:' || chr(10)
  || '    return os.path.join(str(LIMIT), a)' AS code FROM ok""",
)
def x3_parsed(spark, sf):
    """From text to slices: parse once, then joins."""
    return repair.sections(scripts(spark, sf)).withColumnRenamed("section", "name")


@query(
    "m2_script_parts",
    PARSED
    + """, parts AS (SELECT path, p_size, unnest(['import_statements', 'global_variables', 'main_script']) AS part FROM ok)
SELECT path, part, CAST(0 AS BIGINT) AS page, CASE part
  WHEN 'import_statements' THEN 'from flask import Flask, request as rq'
    || CASE WHEN p_size % 4 = 0 THEN chr(10) || 'from .util import helper' ELSE '' END
  WHEN 'global_variables' THEN CASE WHEN p_size % 5 = 0 THEN 'items = []' ELSE '' END
  ELSE CASE WHEN p_size % 3 = 0 THEN 'app = Flask(name)' || chr(10) ELSE '' END
    || 'if __name__ == "__main__":' || chr(10) || '    app.run()' END AS text FROM parts""",
)
def m2(spark, sf):
    """What every script has beside its functions."""
    return repair.script_parts(scripts(spark, sf))


@query(
    "x4_organised_module",
    SYMBOLS
    + GROUPED_SQL
    + """, g AS (SELECT path, import_group, string_agg(statement, chr(10) ORDER BY statement) AS t
  FROM merged JOIN kinds USING (statement) GROUP BY path, import_group)
, imp AS (SELECT path, regexp_replace(
    coalesce(max(t) FILTER (import_group = 'standard') || chr(10), '') || chr(10)
    || coalesce(max(t) FILTER (import_group = 'third_party') || chr(10), '') || chr(10)
    || coalesce(max(t) FILTER (import_group = 'local'), ''), '^\\s+|\\s+$', '', 'g') AS t FROM g GROUP BY path)
, c AS (SELECT path, string_agg(code, chr(10) ORDER BY pos) AS t FROM (
    SELECT path, name, arg_max(code, pos) AS code, min(pos) AS pos FROM v_assigns WHERE name LIKE 'CONST%' GROUP BY path, name)
  GROUP BY path)
, inst AS (SELECT path, string_agg(code, chr(10) ORDER BY pos) AS t FROM v_assigns
  WHERE name NOT LIKE 'CONST%' AND call_arg IS NOT NULL GROUP BY path)
, o AS (SELECT path, string_agg(code, chr(10) ORDER BY pos) AS t FROM v_methods GROUP BY path)
, p AS (SELECT path FROM v_imports UNION SELECT path FROM v_assigns UNION SELECT path FROM v_methods)
SELECT p.path, CAST(0 AS BIGINT) AS page, coalesce(imp.t, '') || chr(10) || chr(10) || coalesce(c.t, '')
  || chr(10) || chr(10) || coalesce(inst.t, '') || chr(10) || chr(10) || coalesce(o.t, '') AS code
FROM p LEFT JOIN imp USING (path) LEFT JOIN c USING (path) LEFT JOIN inst USING (path) LEFT JOIN o USING (path)""",
)
def x4(spark, sf):
    merged = sy.merged_imports(view(spark, sf, "v_imports"))
    return sy.organised_module(merged, view(spark, sf, "v_assigns"), view(spark, sf, "v_methods"))
