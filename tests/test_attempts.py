import pytest
from pyspark.sql import functions as F

from lintlake.operators import attempts as at
from lintlake.operators import prompts as pr
from lintlake.operators import rules
from lintlake.plans import repair

SCHEMA = "path string, section string, iteration int, code_block string, fixed_code string, passed boolean"


def resolve(spark, rows, allowance=3):
    df = spark.createDataFrame([("p", *r) for r in rows], SCHEMA).repartition(4)
    return {r.section: (r.code, r.passed, r.status) for r in at.resolve(df, allowance).collect()}


def test_resolution(spark):
    got = resolve(
        spark,
        [("gap", 1, "a", "A", False), ("gap", 2, None, None, None), ("gap", 3, "c", "C", True),
         ("ok", 1, "a", "A", False), ("ok", 2, "b", "B", True), ("ok", 3, "c", "C", True),
         ("never", 1, "a", "A", False), ("never", 2, "b", "B", False), ("never", 3, "c", "C", False),
         ("empty", 1, "", "", True), ("late", 3, "c", "C", True), ("late", 1, "a", "A", False), ("late", 2, "b", "B", False),
         ("open", 1, "a", "A", False), ("open", 0, "o", "O", True)],
    )
    assert got == {
        "gap": (None, False, "no_code"), "ok": ("B", True, "passed"), "never": ("c", False, "spent"),
        "empty": (None, False, "no_code"), "late": ("C", True, "passed"), "open": (None, False, "open"),
    }


def test_tests_keep_the_original(spark):
    df = spark.createDataFrame(
        [("p", "a", 1, "FAILED", "", "orig"), ("p", "a", 2, "ok", "", "fixed"), ("p", "b", 1, "x", "error", "orig"), ("p", "b", 4, "ok", "", "x")],
        "path string, section string, iteration int, stdout string, stderr string, original string",
    )
    got = {r.section: (r.runs, r.code) for r in at.resolve_tests(df, 3).collect()}
    assert got == {"a": (2, "orig"), "b": (None, None)}


def test_carried_libraries(spark):
    df = spark.createDataFrame(
        [("p", "s", 0, "", "import a", None), ("p", "s", 1, "import b", "import b\nimport flask", False),
         ("p", "s", 2, None, None, False), ("p", "s", 3, "import c", "", False)],
        SCHEMA,
    )
    got = {r.iteration: r.libraries for r in at.carried_libraries(df).collect()}
    assert got == {0: ["a"], 1: ["a"], 2: ["b", "flask"], 3: []}
    originals = spark.createDataFrame([("p", "s", "import o")], "path string, section string, code string")
    got = {r.iteration: r.libraries for r in at.carried_libraries(df.filter("iteration > 0"), originals).collect()}
    assert got == {1: ["o"], 2: ["b", "flask"], 3: []}
    assert at.carried_libraries(df.filter("iteration = 1")).first().libraries == []


def test_template_values_are_not_filled_again(spark):
    c = pr.render_template("{a} {{x}} {b}", {"a": F.lit("{b}"), "b": F.lit(7)})
    assert spark.range(1).select(c.alias("c")).first().c == "{b} {x} 7"


def test_whole_prompt(spark):
    """One attempt against the text a plain loop over the tools would build."""
    code = "import os\nos.system(x)"
    attempts = spark.createDataFrame([("p", "s", 1, code), ("p", "s", 5, code)], "path string, section string, iteration int, code string")
    originals = spark.createDataFrame([("p", "s", code)], "path string, section string, code string")
    found = spark.createDataFrame(
        [("p", "s", 1, "bandit", 1, "- two"), ("p", "s", 1, "bandit", 0, "- one"), ("p", "s", 1, "mypy", 0, "Line: 1\n\tMessage: m\n")],
        "path string, section string, iteration int, tool string, pos int, text string",
    )
    template = "T\n{substitution_code_instruction}|{word_count}|{line_count}\n"
    rows = repair.prompts(attempts, originals, found, template, "sys", {"os.system": "avoid", "zip": "no"}, 4).collect()
    assert [(r.iteration, r.temperature) for r in rows] == [(1, 0.5)]
    said = "has identified the following issues in the provided Python code:\n"
    issues = (
        f"**Adhere to Best Security Practices:**\nBandit {said}- one\n- two\n\n"
        f"\n\n**Adhere to These Linter Findings:**\nMypy {said}Line: 1\n\tMessage: m"
    )
    words, lines = int(3 * 1.2 + 3 * 0.5 / 4), int(2 * 1.1 + 2 * 0.5 / 4)
    filled = f"T\n{rules.SUBSTITUTION_INTRO}\t* For 'os.system', avoid\n|{words}|{lines}"
    assert rows[0].messages[1].content == f"{issues}\n\n{filled}\n\n{code}"
    assert rows[0].messages[0].content == "sys"


def test_round_trip_of_a_repair(spark, sample):
    files = spark.createDataFrame([("s.py", sample)], "path string, text string")
    sections = repair.sections(files)
    responses = sections.select(
        "path", "section", F.lit(1).alias("iteration"),
        F.concat(F.lit("Sure\n```python\n"), F.col("section"), F.lit(" = 1\n```")).alias("response"),
    )
    none = spark.createDataFrame([], "path string, section string, iteration int, tool string, pos int, text string")
    resolved = repair.resolve(repair.attempts_from(responses, none), 3)
    assert [r.text for r in repair.consolidated(resolved).collect()] == ["enter = 1\n\n\nlookup = 1\n\n\n"]


def test_first_and_last_attempt(spark):
    from lintlake.operators import findings as fi

    attempts = spark.createDataFrame(
        [("p", "s", i) for i in range(3)] + [("p", "clean", 0), ("p", "clean", 1), ("p", "one", 0)], "path string, section string, iteration int"
    )
    found = spark.createDataFrame(
        [("p", "s", 0, 1), ("p", "s", 0, 2), ("p", "s", 1, 9), ("p", "s", 2, 2), ("p", "s", 2, 3), ("p", "clean", 0, 5), ("p", "one", 0, 7)],
        "path string, section string, iteration int, line int",
    )
    got = {(r.section, r.line): r.status for r in fi.compare_first_last(attempts, found, identity=("line",)).collect()}
    assert got == {("s", 1): "fixed", ("s", 2): "kept", ("s", 3): "new", ("clean", 5): "fixed", ("one", 7): "kept"}


def test_schedule(spark):
    df = spark.createDataFrame([("p", "a b\nc")], "path string, text string")
    got = [tuple(r)[1:] for r in at.schedule(df, 2, ["path"]).orderBy("iteration").collect()]
    assert got == [(0, 2, 3, 0.0), (1, 2, 4, 1.0)]


def test_run_labels(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "A"), ("a", "B"), ("b", "A")], "name string, run string")
    assert {r.name: r.label for r in at.run_labels(df).collect()} == {"a": "C", "b": "B"}


@pytest.mark.parametrize("allowance", [1, 2, 7])
def test_resolution_against_a_walk(spark, allowance):
    import random

    rng = random.Random(allowance)
    rows = []
    for s in range(40):
        for i in range(1, rng.randrange(2, 9)):
            code = rng.choice([None, "", f"c{i}", f"d{i}", f"e{i}"])
            rows.append((f"s{s}", i, code, code and code.upper(), rng.random() < 0.25))
    want = {}
    for s in {r[0] for r in rows}:
        want[s] = (None, False, "open")
        for _, i, code, fixed, passed in sorted(r for r in rows if r[0] == s):
            if not code:
                want[s] = (None, False, "no_code")
            elif passed:
                want[s] = (fixed, True, "passed")
            elif i >= allowance:
                want[s] = (code, False, "spent")
            else:
                continue
            break
    assert resolve(spark, rows, allowance) == want
