"""What line alignment shuffles, and the way of keys with many lines."""

import pytest

from lintlake.operators import alignment
from tests.test_alignment import KEYS, found, plain


def shuffled_rows(node) -> int:
    """Rows that the shuffles of a finished plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    children = node.children()
    return own + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_lines_are_shuffled_once(spark):
    """Both versions of 300 sections, 12 lines and 2 findings each."""
    lines = [f"line {k}" if k % 3 else "weak(1)" if k == 3 else "}" for k in range(12)]
    rows = [(f"p{k % 7}", f"s{k}", "\n".join(lines), "\n".join(lines[6:] + lines[:6])) for k in range(300)]
    texts = spark.createDataFrame(rows, "path string, section string, old string, new string")
    before, after = (alignment.lines_of(texts, KEYS, c) for c in ("old", "new"))
    weak = [x.where("content LIKE 'weak%'").selectExpr(*KEYS, "'weak' AS rule_id", "line") for x in (before, after)]
    done = alignment.compare_moved(*weak, alignment.moved_lines(before, after, KEYS), KEYS, ["rule_id"])
    assert {(r.line, r.to, r.status) for r in done.collect()} == {(4, 10, "kept")} and done.count() == 300
    assert shuffled_rows(done._jdf.queryExecution().executedPlan()) <= 300 * (24 + 2)


@pytest.mark.parametrize("large, slots", [(0, 65_536), (30, 65_536), (30, 4)])
def test_keys_with_many_lines(spark, monkeypatch, large, slots):
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "SLOTS", slots)
    pairs = []
    for k in range(16):
        lines = [("}", "", "pass", f"only {i}", f"once {k} {i}")[(i * (k + 3)) % 5] for i in range(4 + 30 * (k % 3 == 0))]
        cut = len(lines) // (2 + k % 3)
        pairs.append(("\n".join(lines), "\n".join(["# new", *lines[cut:], *lines[:cut]])))
    assert found(spark, pairs) == [plain(*p) for p in pairs]


def test_null_keys_and_contents_meet_nothing(spark, monkeypatch):
    rows = [(None, "s", 1, "x"), ("p", None, 1, "x"), ("p", "s", 1, None), ("p", "s", 2, "y")]
    lines = spark.createDataFrame(rows, "path string, section string, line long, content string")
    for large in (alignment.LARGE, 0):
        monkeypatch.setattr(alignment, "LARGE", large)
        assert [tuple(r) for r in alignment.moved_lines(lines, lines, KEYS).collect()] == [("p", "s", 2, 2)]


def test_findings_of_null_keys_and_repeated_places(spark):
    lines = spark.createDataFrame([("p", "s", 1, 5), ("p", "s", 1, 6), (None, "s", 2, 2)], "path string, section string, line long, to long")
    kind = "path string, section string, rule_id string, line long"
    old = spark.createDataFrame([("p", "s", "a", 1), ("p", "s", "a", 1), (None, "s", "a", 2), ("p", "s", None, 3)], kind)
    new = spark.createDataFrame([("p", "s", "a", 6), (None, "s", "a", 2), ("p", "s", None, 3)], kind)
    got = [tuple(r)[:1] + tuple(r)[2:] for r in alignment.compare_moved(old, new, lines, KEYS, ["rule_id"]).collect()]
    want = [("p", "a", 1, None, "fixed"), ("p", "a", 1, 6, "kept"), (None, "a", 2, None, "fixed"), (None, "a", None, 2, "new"), ("p", None, 3, None, "fixed"), ("p", None, None, 3, "new")]
    assert sorted(got, key=str) == sorted(want, key=str)
