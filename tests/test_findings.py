import json

from pyspark.sql import functions as F

from lintlake.functions import formats
from lintlake.operators import findings as fi
from lintlake.sources import config, reports, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rules_collapse_to_first_place_and_last_details(spark):
    df = spark.createDataFrame(
        [("f", 0, "B1", 1, [1], "a"), ("f", 1, "B2", 2, [2], "b"), ("f", 2, "B1", 9, [9, 10], "c")],
        "path string, pos int, test_id string, line_number int, line_range array<int>, issue_text string",
    ).repartition(3)
    collapsed = fi.collapse_rules(df).withColumn(
        "text", formats.bandit(F.col("test_id"), F.col("line_number"), F.col("line_range"), F.col("issue_text"))
    )
    page = fi.issue_pages(collapsed, ["path"]).first()
    assert page.summary == (
        "- Test ID: B1, Line: 9, Line Range: [9, 10], Issue: c\n- Test ID: B2, Line: 2, Line Range: [2], Issue: b"
    )


def test_same_finding_from_two_rulesets(spark):
    schema = "path string, pos int, line int, message string, owasp array<string>, cwe array<string>"
    one = spark.createDataFrame([("f", 0, 3, "m", ["A01"], []), ("f", 1, 4, "n", [], [])], schema)
    two = spark.createDataFrame([("f", 0, 3, "m", ["A01"], []), ("f", 1, 5, "n", [], [])], schema)
    got = fi.union_rulesets([("a", one), ("b", two)]).orderBy("pos").select("line", "pos.ruleset_pos").collect()
    assert [tuple(r) for r in got] == [(3, 0), (4, 0), (5, 1)]


def test_clean_file_and_gate(spark):
    files = spark.createDataFrame([("a.py",), ("a_unit_test.py",), ("b.py",), ("c.py",)], "path string")
    found = spark.createDataFrame(
        [("a.py", "bandit", 0, "x"), ("a_unit_test.py", "bandit", 0, "x"), ("a_unit_test.py", "semgrep", 0, "y"),
         ("b.py", "vulture", 0, "z"), ("ghost.py", "mypy", 0, "z")],
        "path string, tool string, pos int, text string",
    )
    gated = fi.gate_security_scans(found)
    summary = {(r.path, r.tool): r.summary for r in fi.summaries(files, fi.issue_pages(gated)).collect()}
    assert len(summary) == 16
    assert summary[("a.py", "bandit")] == "x"
    assert summary[("a_unit_test.py", "bandit")] == "No issues found."
    failed = files.filter("path = 'c.py'")
    assert rows(fi.verdicts(files, gated, failed=failed)) == [
        ("a.py", False), ("a_unit_test.py", True), ("b.py", True), ("c.py", False),
    ]


def test_sections(spark):
    df = spark.createDataFrame(
        [("a", 0, "bandit", "x"), ("a", 0, "mypy", formats.NO_ISSUES), ("b", 0, "mypy", "y\n"), ("c", 0, "mypy", formats.NO_ISSUES)],
        "path string, page int, tool string, summary string",
    )
    got = {r.path: r.issues for r in fi.issue_sections(df).collect()}
    said = "has identified the following issues in the provided Python code:\n"
    assert got == {
        "a": f"{fi.SECURITY_HEADING}\nBandit {said}x",
        "b": f"{fi.LINTER_HEADING}\nMypy {said}y",
        "c": "",
    }


def test_semgrep_shapes(spark):
    report = {
        "results": [
            {"start": {"line": 3}, "extra": {"message": "m", "metadata": {"owasp": ["A", "B"], "cwe": "C"}}},
            {"extra": {"metadata": {"owasp": None}}},
            {},
        ]
    }
    df = spark.createDataFrame([("f", json.dumps(report)), ("g", "{}"), ("h", "not json")], "path string, r string")
    got = reports.semgrep_findings(df, "r", ["path"]).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [
        ("f", 0, 3, "m", ["A", "B"], ["C"]), ("f", 1, None, None, [], []), ("f", 2, None, None, [], []),
    ]
    assert [r.status for r in reports.report_status(df, "r").orderBy("path").collect()] == ["ok", "ok", "failed"]


def test_typecheck_lines(spark):
    out = "a.py:3: error: X: y\nSuccess: no issues found\na.py:zz: q\nC:\\a.py:1: x\n b.py: 7 :z \r\nfoo"
    df = spark.createDataFrame([("f", out)], "path string, o string")
    got = rows(reports.typecheck_findings(df, "o", ["path"]))
    assert got == [("f", 0, 3, "error: X: y"), ("f", 4, 7, "z")]


def test_report_files(spark, tmp_path):
    (tmp_path / "bandit.json").write_text(
        json.dumps({"results": [{"test_id": "B1", "line_number": 2, "line_range": [2, 3], "issue_text": "t", "x": 1}]}, indent=2)
    )
    (tmp_path / "dodgy.json").write_text(json.dumps({"file": "f"}))
    (tmp_path / "vulture.json").write_text(json.dumps([{"name": "n"}, {"type": "Function", "name": "m"}]))
    got = reports.read_bandit_reports(spark, f"{tmp_path}/bandit.json").collect()
    assert [(r.test_id, r.line_range) for r in got] == [("B1", [2, 3])]
    assert reports.read_dodgy_reports(spark, f"{tmp_path}/dodgy.json").count() == 0
    unused = reports.read_unused_code_reports(spark, f"{tmp_path}/vulture.json").select("type", "name")
    assert rows(unused) == [("Function", "m"), ("Unknown", "n")]


def test_guidance_file(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"os.system": "a", "pickle": "b"}))
    (tmp_path / "list.json").write_text("[1]")
    assert rows(config.read_guidance_map(spark, f"{tmp_path}/map.json")) == [(0, "os.system", "a"), (1, "pickle", "b")]
    try:
        config.read_guidance_map(spark, f"{tmp_path}/list.json").collect()
    except Exception as error:
        assert "not a JSON object" in str(error)
    else:
        raise AssertionError("a list was accepted")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/b.py", 0, "k", "n")], "path string, pos int, variable_name string, reason string")
    unified = fi.unified(df, "dodgy", F.lit("A"))
    sinks.write_findings(unified, f"{tmp_path}/out")
    assert rows(sinks.read_findings(spark, f"{tmp_path}/out").drop("attrs")) == rows(unified.drop("attrs"))
    assert (tmp_path / "out" / "tool=dodgy" / "run=A").is_dir()


def test_results_do_not_depend_on_partitioning(spark):
    base = spark.range(400).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('f', id % 17) END AS path", "id AS pos", "concat('T', id % 5) AS test_id",
        "id % 7 AS line", "concat('m', id % 3) AS message", "concat('t', id) AS text", "elt(1 + id % 4, 'bandit','dodgy','semgrep','mypy') AS tool",
    )
    for make in (
        lambda d: fi.collapse_rules(d, details=("line", "message")),
        lambda d: fi.drop_duplicate_findings(d, fields=("line", "message")),
        lambda d: fi.issue_pages(d),
        lambda d: fi.corroborated(d),
    ):
        first = rows(make(base.repartition(1)))
        assert first and all(rows(make(base.repartition(n, F.rand(n)))) == first for n in (3, 8))
