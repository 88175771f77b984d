"""Typed inputs derived from the test tables, row by row, in SQL both Spark and DuckDB read.

Each view is one table and a list of expressions, so Spark gets a plain
projection (column pruning reaches the scan) and the SQL check gets the same
rows. No backslashes: the two dialects escape differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.session import spread

NL = "chr(10)"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
K_TEXT = "regexp_extract(props, '([0-9]+)', 1)"


def lines(*parts: str) -> str:
    """Text expressions joined by newlines."""
    return f" || {NL} || ".join(f"({p})" for p in parts)


def line(expr: str, when: str) -> str:
    """A line with its newline, only on rows where ``when`` holds."""
    return f"CASE WHEN {when} THEN {expr} || {NL} ELSE '' END"


EVENT_PATH = (
    "'corpus/f' || CAST(user_id AS STRING) || CASE WHEN user_id % 11 = 0 THEN '_unit_test' ELSE '' END || '.py'"
)
TOOL = (
    "CASE event_type WHEN 'view' THEN 'bandit' WHEN 'click' THEN 'dodgy' WHEN 'signup' THEN 'semgrep' "
    "WHEN 'purchase' THEN 'mypy' ELSE 'vulture' END"
)
SCRIPT = " || ".join(
    [
        f"'import os' || {NL}",
        f"'from flask import Flask, request as rq' || {NL}",
        line("'from .util import helper'", "p_size % 4 = 0"),
        f"'LIMIT = ' || CAST(p_size AS STRING) || {NL}",
        line("'app = Flask(name)'", "p_size % 3 = 0"),
        line("'items = []'", "p_size % 5 = 0"),
        line("'# note ' || CAST(p_partkey AS STRING)", "p_partkey % 2 = 0"),
        line("'@route'", "p_partkey % 3 = 0"),
        f"'def run_' || CAST(p_partkey % 5 AS STRING) || '(a: int, b) -> str:' || {NL}",
        f"'    return os.path.join(str(LIMIT), a)  # done' || {NL}",
        line("'class Box:' || chr(10) || '    def size(self):' || chr(10) || '        return 1'", "p_partkey % 4 = 0"),
        f"'if __name__ == \"__main__\":' || {NL} || '    app.run()' || {NL}",
        line("'def broken(:'", "p_partkey % 97 = 0"),
    ]
)
GIB16, MIB = "17163091968", "1048576"
SNAPSHOT = lines(
    "'GPU[0]          : VBIOS version: 113-D' || CAST(user_id AS STRING)",
    "'Driver version: 6.3.1'",
    "CASE WHEN event_id % 9 = 0 THEN '' ELSE 'GPU[0]          : Average Graphics Package Power (W): ' "
    "|| CAST(user_id AS STRING) || '.5' END",
    "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'GPU[0]          : Max Graphics Package Power (W): 303.0' END",
    f"'GPU[0]          : Temperature (Sensor edge) (C): ' || {K_TEXT} || '.5'",
    "'GPU[0]          : dcefclk clock level: 1: (' || CAST(event_id % 800 AS STRING) || 'Mhz)'",
    "'GPU[0]          : mclk clock level: 3: (' || CAST(event_id % 1249 AS STRING) || 'Mhz)'",
    "CASE WHEN event_id % 5 = 0 THEN '' ELSE 'GPU[0]          : sclk clock level: 1: (' "
    "|| CAST(event_id % 2300 AS STRING) || 'Mhz)' END",
    "CASE WHEN event_id % 6 = 0 THEN '' ELSE 'GPU[0]          : Performance Level: auto' END",
    f"'GPU[0]          : GPU use (%): ' || {K_TEXT}",
    f"'GPU[0]          : VRAM Total Memory (B): {GIB16}'",
    f"CASE WHEN event_id % 7 = 0 THEN '' ELSE 'GPU[0]          : VRAM Total Used Memory (B): ' "
    f"|| CAST({K} * CAST({MIB} AS BIGINT) * 100 AS STRING) END",
)

# name -> (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_files": (
        "documents",
        {
            "file_id": "doc_id",
            "path": "'corpus/' || source || '/f' || CAST(doc_id AS STRING)"
            " || CASE WHEN doc_id % 11 = 0 THEN '_unit_test' ELSE '' END"
            " || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 13 = 0 THEN '' ELSE '.py' END",
            "text": "text",
        },
    ),
    "v_code": (
        "part",
        {
            "file_id": "p_partkey",
            "path": "'src/' || lower(p_type) || '/m' || CAST(p_partkey AS STRING) || '.py'",
            "code": lines(
                "'import os'",
                "CASE p_size % 5 WHEN 0 THEN 'from flask import Flask' WHEN 1 THEN 'import django' "
                "WHEN 2 THEN 'import pickle, json' WHEN 3 THEN '  from .util import x' ELSE 'import flask.views' END",
                "'# import ghost'",
                "CASE p_size % 3 WHEN 0 THEN 'os.system(cmd)' WHEN 1 THEN 'subprocess.run(cmd)' ELSE 'print(1)' END",
                "CASE p_size % 7 WHEN 0 THEN '@route' || chr(10) || chr(9) || '# first ' || chr(10) || 'def a(x):' "
                "WHEN 1 THEN '# own' || chr(10) || 'def b():' ELSE 'def c(y):' END",
                "'    return 1'",
            ),
        },
    ),
    "v_scripts": (
        "part",
        {
            "path": "'src/' || lower(p_type) || '/s' || CAST(p_partkey AS STRING) || '.py'",
            "p_partkey": "p_partkey",
            "p_size": "p_size",
            "text": SCRIPT,
        },
    ),
    "v_findings": (
        "events",
        {
            "path": EVENT_PATH,
            "run": "'A'",
            "tool": TOOL,
            "pos": "event_id",
            "rule_id": f"'T' || CAST({K} % 10 AS STRING)",
            "line": f"CAST({K} AS BIGINT)",
            "message": f"'message ' || CAST({K} % 4 AS STRING)",
            "tag": f"CASE {K} % 3 WHEN 0 THEN 'A01' WHEN 1 THEN 'A03' ELSE '' END",
        },
    ),
    "v_bandit_reports": (
        "events",
        {
            "path": EVENT_PATH,
            "report_id": "event_id",
            "report": "'{\"results\":[' || CASE event_id % 3 WHEN 0 THEN '' ELSE "
            f"'{{\"test_id\":\"B' || CAST(100 + {K} AS STRING) || '\",\"line_number\":' || {K_TEXT} "
            f"|| ',\"line_range\":[' || {K_TEXT} || ',' || CAST({K} + 1 AS STRING) || '],\"issue_text\":\"use of x\"}}' END "
            "|| CASE event_id % 3 WHEN 2 THEN ',{\"test_id\":\"B1\",\"line_number\":1,\"line_range\":[1],"
            "\"issue_text\":\"second\"}' ELSE '' END || '],\"metrics\":{\"loc\":3}}'",
        },
    ),
    "v_dodgy_reports": (
        "events",
        {
            "path": EVENT_PATH,
            "report_id": "event_id",
            "report": "'{\"file\":\"f.py\"' || CASE event_id % 3 WHEN 0 THEN '' ELSE "
            f"',\"issues\":[{{\"line_number\":' || {K_TEXT} || ',\"variable_name\":\"key_' || event_type "
            "|| '\",\"reason\":\"Hardcoded\"}]' END || '}'",
        },
    ),
    "v_semgrep_raw": (
        "events",
        {
            "path": EVENT_PATH,
            "pos": "event_id",
            "result_json": f"'{{\"start\":{{\"line\":' || {K_TEXT} || '}},\"extra\":{{\"message\":\"m ' || event_type "
            "|| '\",\"metadata\":{' || CASE event_id % 3 WHEN 0 THEN '\"owasp\":[\"A01\",\"A03\"],\"cwe\":\"CWE-1\"' "
            "WHEN 1 THEN '\"owasp\":\"A03\"' ELSE '' END || '}}}'",
        },
    ),
    "v_typecheck": (
        "events",
        {
            "path": EVENT_PATH,
            "report_id": "event_id",
            "output": lines(
                "CASE event_id % 4 WHEN 0 THEN 'Success: no issues found' WHEN 1 THEN 'a.py:zz: note' "
                f"ELSE 'a.py: ' || {K_TEXT} || ' : error: bad: type ' END",
                f"CASE event_id % 3 WHEN 0 THEN '' ELSE 'b.py:' || CAST({K} + 1 AS STRING) || ': note: ' || event_type END",
                "'Found ' || CAST(event_id AS STRING) || ' errors'",
            ),
        },
    ),
    "v_unused": (
        "events",
        {
            "path": EVENT_PATH,
            "report_id": "event_id",
            "report": "'[{' || CASE event_id % 3 WHEN 0 THEN '\"type\":\"Function\",\"name\":\"' || event_type || '\"' "
            "WHEN 1 THEN '\"name\":\"v' || CAST(event_id AS STRING) || '\"' ELSE '\"type\":\"Variable\"' END || '}]'",
        },
    ),
    "v_completions": (
        "conversations",
        {
            "conv_id": "conv_id",
            "turn": "turn",
            "response": f"CASE turn % 4 WHEN 0 THEN 'Sure.' || {NL} || '```python' || {NL} "
            f"|| 'from your_module import thing' || {NL} || 'x = ' || CAST(conv_id AS STRING) || {NL} || '```' "
            f"|| {NL} || '```python' || {NL} || 'second' || {NL} || '```' "
            f"WHEN 1 THEN '[HIGH] Line 3-5: close file' || {NL} || '[CRITICAL] Line 2: stop' || {NL} "
            f"|| '[LOW] Line 9: add logger' || {NL} || '[MEDIUM] Line ' || CAST(conv_id AS STRING) || ': check ' || role "
            f"WHEN 2 THEN '**Secure Implementation Title**: Use json ' || CAST(conv_id AS STRING) || '  ' || {NL} "
            f"|| '**Secure Implementation Statement:** drop pickle' || {NL} || 'the pickle module and os  module' || {NL} "
            f"|| '**Secure Code Implementation Statement**:' || {NL} || 'one' || {NL} || 'two' || {NL} "
            f"ELSE '```python' || {NL} || '```' END || text",
            "stdout": "CASE turn % 3 WHEN 0 THEN '2 passed' WHEN 1 THEN '1 failed' ELSE 'ok' END",
            "stderr": "CASE turn % 5 WHEN 0 THEN 'Error: x' ELSE '' END",
        },
    ),
    "v_chunks": (
        "conversations",
        {
            "request_id": "conv_id",
            "seq": "turn",
            "chunk": "CASE WHEN turn % 5 = 4 THEN '{\"choices\":[{\"delta\":{}}]}' "
            "ELSE '{\"choices\":[{\"delta\":{\"content\":\"w' || CAST(length(text) AS STRING) || ' \"}}]}' END",
        },
    ),
    "v_attempts": (
        "events",
        {
            "path": "'p' || CAST(user_id % 7 AS STRING)",
            "section": "'fn_' || CAST(user_id AS STRING)",
            "event_id": "event_id",
            "code_block": f"CASE WHEN event_type = 'error' AND {K} % 4 = 0 THEN NULL ELSE "
            f"'import ' || event_type || {NL} || 'code = ' || CAST(event_id AS STRING) END",
            "fixed_code": f"'import fixed_' || event_type || {NL} || 'code = ' || CAST(event_id AS STRING)",
            "passed": f"event_type = 'view' AND {K} % 3 = 0",
            "stdout": "CASE event_type WHEN 'view' THEN '3 passed' WHEN 'click' THEN '1 Failed' ELSE 'ERROR in x' END",
            "stderr": f"CASE WHEN {K} % 5 = 0 THEN 'error: y' ELSE '' END",
            "run": "CAST(CAST(floor(event_id / 97) AS BIGINT) AS STRING)",
        },
    ),
    "v_sections": (
        "events",
        {
            "path": EVENT_PATH,
            "project": "'prj' || CAST(user_id % 7 AS STRING)",
            "file_id": "user_id",
            "pos": "event_id",
            "name": "CASE WHEN event_id % 13 = 0 THEN 'main' ELSE 'fn_' || CAST(event_id % 12 AS STRING) END",
            "code": "'def f(): return ' || CAST(event_id AS STRING)",
            "arg": "event_type",
            "arg_type": f"CASE WHEN {K} % 2 = 0 THEN 'int' ELSE NULL END",
            "returns": f"CASE WHEN {K} % 3 = 0 THEN 'str' ELSE NULL END",
        },
    ),
    "v_assigns": (
        "orders",
        {
            "path": "'corpus/o' || CAST(o_custkey % 300 AS STRING) || '.py'",
            "pos": "o_orderkey",
            "name": "CASE o_orderkey % 3 WHEN 0 THEN 'CONST_' ELSE 'var_' END || CAST(o_orderkey % 40 AS STRING)",
            "code": "'v = ' || CAST(o_orderkey AS STRING)",
            "call_class": "CASE WHEN o_orderstatus = 'F' THEN 'Flask' ELSE NULL END",
            "call_arg": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'name' ELSE NULL END",
        },
    ),
    "v_refs": (
        "lineitem",
        {
            "path": "'corpus/o' || CAST(l_orderkey % 300 AS STRING) || '.py'",
            "scope": "CASE WHEN l_linenumber = 1 THEN '__main__' ELSE 'fn_' || CAST(l_linenumber AS STRING) END",
            "name": "CASE l_partkey % 3 WHEN 0 THEN 'CONST_' ELSE 'var_' END || CAST(l_partkey % 60 AS STRING)",
        },
    ),
    "v_imports": (
        "orders",
        {
            "path": "'corpus/o' || CAST(o_custkey % 300 AS STRING) || '.py'",
            "project": "'prj' || CAST(o_custkey % 7 AS STRING)",
            "pos": "o_orderkey",
            "alias_pos": "0",
            "module": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'flask' WHEN 2 THEN 'os' ELSE '.util' END",
            "name": "CASE o_orderkey % 4 WHEN 0 THEN 'requests' || CAST(o_orderkey % 3 AS STRING) "
            "ELSE 'var_' || CAST(o_orderkey % 20 AS STRING) END",
            "code": "CASE o_orderkey % 4 WHEN 0 THEN 'import requests' || CAST(o_orderkey % 3 AS STRING) "
            "WHEN 1 THEN 'from flask import var_' || CAST(o_orderkey % 20 AS STRING) "
            "WHEN 2 THEN 'from os import var_' || CAST(o_orderkey % 20 AS STRING) "
            "ELSE 'from .util import var_' || CAST(o_orderkey % 20 AS STRING) END",
        },
    ),
    "v_methods": (
        "orders",
        {
            "path": "'corpus/o' || CAST(o_custkey % 300 AS STRING) || '.py'",
            "pos": "o_orderkey",
            "name": "'fn_' || CAST(o_orderkey % 8 AS STRING)",
            "code": "'def f(): return ' || CAST(o_orderkey AS STRING)",
        },
    ),
    "v_telemetry": (
        "events",
        {"event_id": "event_id", "ts": "ts", "device": "user_id % 2", "snapshot": SNAPSHOT},
    ),
}


SPREAD_BY = {
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "events": ("event_id",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey"),
    "part": ("p_partkey",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. A test file is a single row group, so a single task reads it all; ``spread`` hands its
    rows to every core. A scan with enough partitions of its own, as on a cluster, is not shuffled."""
    source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(source, *SPREAD_BY[name]) if name in SPREAD_BY else source


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return project(table(spark, sf_dir, VIEWS[name][0]), name)


def project(df: DataFrame, name: str) -> DataFrame:
    """The view's projection over any frame with the source columns, for example a stream."""
    return df.selectExpr(*[f"{expr} AS {column}" for column, expr in VIEWS[name][1].items()])


def with_views(*names: str) -> str:
    """A ``WITH`` clause that defines the views for the SQL check."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        chosen = ", ".join(f"{expr} AS {column}" for column, expr in columns.items())
        parts.append(f"{name} AS (SELECT {chosen} FROM {source})")
    return "WITH " + ",\n".join(parts)
