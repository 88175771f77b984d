"""Lines that moved between two versions, against a plain search."""

import random

import pytest

from lintlake.operators import alignment

KEYS = ["path", "section"]


def plain(before, after):
    """{line: to} of one text, lines counted from 1."""
    a, b = ([] if t is None else t.split("\n") for t in (before, after))
    once = [x for x in a if x.strip(" ") and a.count(x) == 1 and b.count(x) == 1]
    anchor = {a.index(x) + 1: b.index(x) + 1 for x in once}
    free = {j for j in range(1, len(b) + 1) if j not in anchor.values()}
    best = {}
    for i in range(1, len(a) + 1):
        if i in anchor:
            continue
        above = max((k for k in anchor if k < i), default=None)
        below = min((k for k in anchor if k > i), default=None)
        for rank, k in enumerate((above, below)):
            to = None if k is None else i + anchor[k] - k
            if to in free and a[i - 1] == b[to - 1] and i not in best:
                best[i] = (rank, to)
    out = dict(anchor)
    for to in {t for _, t in best.values()}:
        _, line = min((r, i) for i, (r, t) in best.items() if t == to)
        out[line] = to
    return out


def aligned(spark, pairs):
    def lines(at):
        rows = [(f"p{k % 2}", f"s{k}", pair[at]) for k, pair in enumerate(pairs)]
        return alignment.lines_of(spark.createDataFrame(rows, "path string, section string, code string"), KEYS)

    return alignment.moved_lines(lines(0), lines(1), KEYS)


def found(spark, pairs):
    out = [{} for _ in pairs]
    for r in aligned(spark, pairs).collect():
        assert r.line not in out[int(r.section[1:])]
        out[int(r.section[1:])][r.line] = r.to
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_equals_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng, pairs = random.Random(block), []
    for _ in range(25):
        lines = [rng.choice(["}", "", "  ", "pass", f"line {rng.randrange(40)}", f"only {rng.randrange(10**6)}"]) for _ in range(rng.randrange(1, 40))]
        other = list(lines)
        for _ in range(rng.randrange(4)):
            at, to, n = rng.randrange(len(other)), rng.randrange(len(other)), rng.randrange(5)
            moved = other[at : at + n]
            del other[at : at + n]
            other[to:to] = moved + ["fresh"] * rng.randrange(2)
        pairs.append(("\n".join(lines), "\n".join(other)))
    pairs += [("a", None), (None, "a"), ("", ""), ("x\nx", "x\nx"), ("same\n}\nend\n}", "end\n}\nsame\n}")]
    assert found(spark, pairs) == [plain(*p) for p in pairs]


def test_a_finding_that_only_moved_is_kept(spark):
    before = "import os\ndef f():\n    call()\n}\ndef g():\n    weak(1)\n}"
    after = "# note\nimport os\ndef g():\n    weak(1)\n}\ndef f():\n    call()\n}\nweak(2)"
    rows = aligned(spark, [(before, after)])
    kind = "path string, section string, tool string, rule_id string, line long"
    old = spark.createDataFrame([("p0", "s0", "t", "weak", 6), ("p0", "s0", "t", "gone", 3), ("p0", "s0", "t", "weak", 6)], kind)
    new = spark.createDataFrame([("p0", "s0", "t", "weak", 4), ("p0", "s0", "t", "weak", 9)], kind)
    got = [tuple(r)[3:] for r in alignment.compare_moved(old, new, rows).collect()]
    assert sorted(got, key=str) == sorted([("weak", 6, 4, "kept"), ("weak", None, 9, "new"), ("gone", 3, None, "fixed")], key=str)


def test_empty(spark):
    assert aligned(spark, [(None, None)]).collect() == []


def test_lines_are_never_broadcast(spark, tmp_path, capsys):
    """An explode makes more rows than Spark takes them for."""
    rows = [("p", "s", "a\nweak(1)\nb", "b\na\nweak(1)")]
    spark.createDataFrame(rows, "path string, section string, old string, new string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    before, after = (alignment.lines_of(texts, KEYS, c) for c in ("old", "new"))
    found = [x.where("content LIKE 'weak%'").selectExpr(*KEYS, "'weak' AS rule_id", "line") for x in (before, after)]
    alignment.compare_moved(*found, alignment.moved_lines(before, after, KEYS), KEYS, ["rule_id"]).explain()
    assert "Broadcast" not in capsys.readouterr().out
