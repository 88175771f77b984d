"""Edge rows of the text functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.functions import budget, formats
from lintlake.functions import text as tx


def values(spark, items, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_libraries(spark):
    code = "import a, b\nimport os.path\n  from flask import X\nfrom . import z\n# import no\nimport näme\n\n\nfrom .m import q"
    odd = "x = ' import ghost'\nimport real"
    assert values(spark, [code, odd, ""], tx.extract_libraries) == [
        ["a", "os.path", "flask", ".", "näme", ".m"], ["real"], [],
    ]


def test_code_block(spark):
    texts = ["none", "```python\n```", "```python\na\n```x```python\nb\n```"]
    assert values(spark, texts, tx.extract_code_block) == [None, None, "a\n"]


def test_module_names(spark):
    assert values(spark, ["the pickle  module, os modules", ""], tx.extract_module_names) == [["pickle"], []]


def test_titled_fields(spark):
    text = "**Secure Implementation Title:** Use  json \nrest"
    assert values(spark, [text, "**Secure Implementation Title**\n", "x"], tx.implementation_title) == [
        "Use  json", "", None,
    ]
    body = "**Secure Code Implementation Statement**: a\nb\n"
    assert values(spark, [body], tx.code_statement) == ["ab"]


def test_quality_issues(spark):
    text = "[CRITICAL] Line 2: x\n[LOW] Line 9: add logger\n[HIGH] Line 3-5: fix"
    assert values(spark, [text], tx.quality_summary) == ["priority: HIGH, corrective action: fix"]
    assert values(spark, [text], lambda c: tx.quality_summary(c, True)) == [
        "priority: CRITICAL, corrective action: x\npriority: HIGH, corrective action: fix"
    ]


def test_module_import(spark):
    paths = ["m/a.py", "a.py", "m/x.py.d/a.py", "m/noext", ".bashrc"]
    assert values(spark, paths, tx.module_import) == ["from m.a", "from .a", "from m.x.d.a", "from m.noext", "from .bashrc"]


def test_split_name(spark):
    import os.path

    paths = ["a/b.py", "b.tar.gz", ".bashrc", "x/..a.b", "x/...", "a.", "noext", "d.e/f"]
    assert values(spark, paths, tx.extension) == [os.path.splitext(p.split("/")[-1])[1] for p in paths]
    assert values(spark, paths, tx.stem) == [os.path.splitext(p.split("/")[-1])[0] for p in paths]


def test_report_path(spark):
    assert values(spark, ["a/b/c.py", "c.py"], tx.report_path) == ["bandit_a_b_c.json", "bandit__c.json"]


def test_placeholder_imports(spark):
    code = "from your_module import x  \n\nfoo\nfrom your_module\nz"
    want = re.sub(r"^from your_module(.*?)\s*$", "", code, flags=re.MULTILINE)
    assert values(spark, [code], tx.strip_placeholder_imports) == [want]
    lazy = re.sub(r"^from your_module import .*", "", code, flags=re.MULTILINE)
    assert values(spark, [code], lambda c: tx.strip_placeholder_imports(c, True)) == [lazy]


def test_outcome(spark):
    rows = spark.createDataFrame([("ok", ""), ("1 Failed", ""), ("ok", "an error"), ("ERROR", "")], "a string, b string")
    got = [r.o for r in rows.select(tx.test_outcome(F.col("a"), F.col("b")).alias("o")).collect()]
    assert got == [True, False, False, False]


def test_split_lines(spark):
    texts = ["a\nb", "a\r\nb\n", "", "a b\x0cc", "\n", "a\n\n"]
    assert values(spark, texts, tx.split_lines) == [t.splitlines() for t in texts]


@pytest.mark.parametrize("labels", [{0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}])
def test_run_label(spark, labels):
    assert values(spark, list(labels), budget.run_label, "bigint") == list(labels.values())


def test_run_label_order(spark):
    """Labels of consecutive numbers are distinct and grow, up to the largest number."""

    def letters(n):
        out = ""
        while n >= 0:
            n, digit = divmod(n, 26)
            out, n = chr(65 + digit) + out, n - 1
        return out

    numbers = [*range(0, 2000), *range(475_250, 475_260), 2**40, 2**62, 2**63 - 1]
    assert values(spark, numbers, budget.run_label, "bigint") == [letters(n) for n in numbers]


def test_temperature(spark):
    pairs = [(n, i) for n in range(1, 260) for i in range(0, n + 3)]
    df = spark.createDataFrame([(k, n, i) for k, (n, i) in enumerate(pairs)], "k int, n int, i int")
    got = [r.t for r in df.select("k", budget.temperature(F.col("n"), F.col("i")).alias("t")).orderBy("k").collect()]
    assert got == [round(min(2.0, 2.0 / n * i), 2) for n, i in pairs]


def test_rounding_follows_the_binary_value(spark):
    import random

    rng = random.Random(5)
    numbers = [k / 200 for k in range(0, 20001)] + [rng.uniform(0, 100) for _ in range(3000)] + [-0.125, -1.005, -2.675]
    assert values(spark, numbers, budget.round_to_cents, "double") == [round(x, 2) for x in numbers]


def test_sizes_of_empty_text(spark):
    assert values(spark, ["", "a\n", "a b\x1cc"], budget.line_count) == [1, 2, 1]
    assert values(spark, ["", "a\n", "a b\x1cc"], budget.word_count) == [0, 1, 3]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t 　\x1dé", max_size=30), min_size=1, max_size=40))
def test_words_and_strip_follow_python(spark, texts):
    assert values(spark, texts, budget.word_count) == [len(t.split()) for t in texts]
    assert values(spark, texts, tx.strip) == [t.strip() for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.m\n \t,#frimpot", max_size=40), min_size=1, max_size=40))
def test_libraries_follow_python(spark, texts):
    texts = [t + "\nfrom a.b import c\n import x" + t for t in texts]
    pattern = r"^\s*(?:import\s+([\w\.]+)|from\s+([\w\.]+)\s+import\s+)"
    want = [[g for m in re.findall(pattern, t, re.MULTILINE) for g in m if g] for t in texts]
    assert values(spark, texts, tx.extract_libraries) == want


def test_formats_of_missing_fields(spark):
    row = spark.range(1).select(
        formats.semgrep(F.lit(None).cast("int"), F.lit("m"), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b"))).alias("s"),
        formats.vulture(F.lit(None).cast("string"), F.lit("n")).alias("v"),
    ).first()
    assert row.s == "  Line: None\n  Message: m\n  OWASP: None\n  CWE: a, b\n"
    assert row.v == "\t\t\tType: Unknown --> Name: n\n"
