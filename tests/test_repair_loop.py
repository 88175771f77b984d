"""The repair loop: sections that stop in different rounds, against a plain loop and the stored attempts."""

import re

import pytest
from pyspark.sql import functions as F

from lintlake.functions import formats
from lintlake.operators import attempts as at
from lintlake.plans import repair_loop
from lintlake.plans.repair_queries import complete, scan

ALLOWANCE = 4
GUIDANCE = {"weak(": "call the safe one"}


def run(spark, rows, completer=complete, scanner=scan, allowance=ALLOWANCE, fix=lambda c: F.concat(F.lit("import auto\n"), c)):
    sections = spark.createDataFrame([(p, s, c, "x") for p, s, c in rows], "path string, section string, code string, iteration string")
    return repair_loop.repair_corpus(sections, scanner, completer, "{substitution_code_instruction}Go.", "sys", GUIDANCE, allowance, fix)


def plain(code, path, allowance=ALLOWANCE):
    """The loop over one section."""
    attempts, fixed = [], code
    for i in range(allowance):
        if "stubborn" in fixed and 2 * i / allowance >= 0.8:
            return attempts + [(i + 1, None, None, False)], (i + 1, None, False, "no_code")
        lines = fixed.split("\n")
        n = 0 if "unit_test" in path else sum(x.startswith("weak(") for x in lines)
        n += sum(x.startswith("untyped ") for x in lines)
        body = "\n".join(lines[1:])
        body = body.replace("weak(", "safe(", 1) if "weak(" in body else body.replace("untyped ", "typed ")
        block = f"# t {round(2 / allowance * i, 2)} n {n}\n{body}"
        fixed = "import auto\n" + block
        ok = not re.search("^untyped ", fixed, re.M) and ("unit_test" in path or not re.search(r"^weak\(", fixed, re.M))
        attempts.append((i + 1, block, fixed, ok))
        if ok:
            return attempts, (i + 1, fixed, True, "passed")
    return attempts, (allowance, block, False, "spent")


ROWS = [(f"a{n % 2}.py", f"f{n}", "import os\n" + "weak(1)\n" * n + ("untyped = 1\n" if n % 3 == 0 else "") + ("stubborn" if n in (2, 5) else "easy")) for n in range(7)]
ROWS += [("t_unit_test.py", "g", "import os\nweak(1)\nweak(2)\neasy"), ("clean.py", "h", "import os\neasy")]


@pytest.fixture(scope="module")
def repaired(spark):
    return run(spark, ROWS)


def test_equals_plain_loop(repaired):
    want = [(p, s, *a) for p, s, c in ROWS for a in plain(c, p)[0]]
    got = [tuple(r) for r in repaired.attempts.drop("libraries").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    ends = {(p, s): plain(c, p)[1] for p, s, c in ROWS}
    assert {(r.path, r.section): (r.iteration, r.code, r.passed, r.status) for r in repaired.resolved.collect()} == ends
    assert {e[0] for e in ends.values()} == {1, 2, 3, 4} and {e[3] for e in ends.values()} == {"passed", "no_code", "spent"}
    assert repaired.rounds == ALLOWANCE


def test_equals_resolution_of_the_stored_attempts(repaired):
    columns = ["path", "section", "iteration", "code", "passed", "status"]
    again = at.resolve(repaired.attempts, ALLOWANCE).select(columns)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, repaired.resolved.select(columns).collect()), key=str)


def test_libraries_are_those_of_the_code_before(repaired):
    libraries = {(r.section, r.iteration): r.libraries for r in repaired.attempts.collect()}
    assert libraries["f3", 1] == ["os"] and libraries["f3", 2] == ["auto"]


def test_only_the_frontier_is_prompted_and_it_ends_early(spark):
    asked = []

    def counting(prompts):
        asked.append(sorted((r.section, r.iteration) for r in prompts.collect()))
        return complete(prompts)

    done = run(spark, [("a.py", "one", "import os\nweak(1)\neasy"), ("a.py", "two", "import os\nweak(1)\nweak(1)\neasy")], counting, allowance=9)
    assert asked == [[("one", 0), ("two", 0)], [("two", 1)]] and done.rounds == 2


def test_odd_sections_and_silent_models(spark):
    silent = lambda prompts: complete(prompts).where("section <> 'quiet'")
    rows = [("a.py", "quiet", "import os\nweak(1)"), ("a.py", "null", None), ("a.py", "empty", ""), ("b.py", "twice", "import a\neasy"), ("b.py", "twice", "import b\neasy")]
    done = run(spark, rows, silent)
    assert {r.section: (r.iteration, r.status) for r in done.resolved.collect()} == {"quiet": (1, "no_code"), "null": (1, "passed"), "empty": (1, "passed"), "twice": (1, "passed")}
    assert run(spark, []).resolved.collect() == []
    with pytest.raises(ValueError):
        run(spark, rows, allowance=0)


def test_pages_of_findings_give_one_attempt(spark, monkeypatch):
    from lintlake.operators import findings as fi
    from lintlake.operators import paging

    pages = lambda df, keys: paging.text_pages(df, keys, "pos", "text", "\n", "summary", rows=2)
    monkeypatch.setattr(fi, "issue_pages", pages)
    seen = []

    def pagewise(prompts):
        seen.extend(r.page for r in prompts.collect())
        return complete(prompts)

    done = run(spark, [("a.py", "f", "import os\n" + "weak(1)\n" * 5 + "easy")], pagewise, allowance=1)
    assert sorted(seen) == [0, 1, 2]
    assert [(r.iteration, r.passed) for r in done.attempts.collect()] == [(1, False)]


def test_a_scanner_may_use_the_libraries(spark):
    def by_library(rows):
        bad = rows.where(F.array_contains("libraries", "os"))
        return bad.select("path", "section", "iteration", F.lit("mypy").alias("tool"), F.lit(0).alias("pos"), formats.mypy(F.lit(1), F.lit("os")).alias("text"))

    done = run(spark, [("a.py", "f", "import os\neasy")], scanner=by_library)
    assert [(r.iteration, r.passed) for r in done.attempts.orderBy("iteration").collect()] == [(1, False), (2, True)]


def test_sizes_of_originals_are_counted_once(spark, monkeypatch):
    from lintlake.functions import budget

    counted, words = [], budget.word_count
    monkeypatch.setattr(budget, "word_count", lambda text: counted.append(1) or words(text))
    done = run(spark, [("a.py", "f", "import os\n" + "weak(1)\n" * 3 + "easy")])
    assert done.rounds == 3 and len(counted) == 1
    assert done.attempts.columns == ["path", "section", "iteration", "code_block", "fixed_code", "libraries", "passed"]


def test_sections_with_null_keys_are_never_prompted(spark):
    done = run(spark, [(None, "f", "import os\neasy"), ("a.py", None, "import os\nweak(1)"), ("a.py", "f", "import os\neasy")])
    got = {(r.path, r.section): (r.iteration, r.status) for r in done.resolved.collect()}
    assert got == {(None, "f"): (1, "no_code"), ("a.py", None): (1, "no_code"), ("a.py", "f"): (1, "passed")}


def test_prompts_take_the_sizes_that_attempts_carry(spark):
    from lintlake.operators import prompts as pr

    originals = spark.createDataFrame([("a.py", "f", "x = 1\ny = 2"), ("a.py", None, "z")], "path string, section string, code string")
    attempts = originals.withColumn("iteration", F.lit(1)).withColumn("code", F.lit("q"))
    issues = spark.createDataFrame([], "path string, section string, iteration int, page bigint, issues string")
    asked = lambda rows, by: pr.prompt_rows(rows, issues, by, "{line_count} {word_count}", "sys", {}, 4).collect()
    sizes = pr.with_sizes(originals).select("path", "section", "_lines", "_words")
    carried = attempts.join(sizes, attempts["section"].eqNullSafe(sizes["section"])).select(attempts["*"], "_lines", "_words")
    assert asked(carried, None) == asked(attempts, originals) and len(asked(carried, None)) == 1
