"""Trees of files and reports: odd files, retries, failed jobs, pages of results."""

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.sources import sinks, trees


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["path", "text"])


def names(root):
    return sorted(p.name for p in Path(root).rglob("*") if p.is_file() and p.name != "_SUCCESS")


def test_odd_files(spark, tmp_path):
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    (tmp_path / "a" / "crlf.py").write_bytes(b"x = 1\r\ny = 2\rz = 3\n")
    (tmp_path / "a" / "empty.py").write_bytes(b"")
    (tmp_path / "a" / "bytes.py").write_bytes(b"\xff\xfe")
    (tmp_path / "a" / ".hidden" / "in.py").write_text("é\n", encoding="utf-8")
    (tmp_path / "a" / "UPPER.PY").write_text("no")
    (tmp_path / "a" / f"{trees._JOB}x").mkdir()
    (tmp_path / "a" / f"{trees._JOB}x" / "staged.py").write_text("no")
    rows = {Path(r.path).name: (r.status, r.bytes, r.text) for r in trees.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {
        "crlf.py": ("ok", 19, "x = 1\ny = 2\nz = 3\n"), "empty.py": ("empty", 0, ""), "bytes.py": ("not_text", 2, None), "in.py": ("ok", 3, "é\n"),
    }


def test_files_that_go_away_are_unreadable(tmp_path):
    (tmp_path / "gone.py").write_text("x")
    reader = trees.TreeReader(str(tmp_path), ".py", 10)
    parts = reader.partitions()
    (tmp_path / "gone.py").unlink()
    (found,) = [b for p in parts for b in reader.read(p)]
    assert found.to_pylist() == [{"path": str(tmp_path / "gone.py"), "status": "unreadable", "bytes": 1, "text": None}]


def test_partitions_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "PARTITION_FILES", 4)
    for n in range(10):
        (tmp_path / f"f{n}.py").write_text("x" * n)
    parts = trees.TreeReader(str(tmp_path), ".py", 12).partitions()
    assert sorted(p for part in parts for p, _ in part.files) == sorted(str(tmp_path / f"f{n}.py") for n in range(10))
    assert all(len(p.files) <= 4 and (len(p.files) == 1 or sum(n for _, n in p.files) <= 12) for p in parts)


def test_an_empty_tree(spark, tmp_path):
    assert trees.read_tree(spark, str(tmp_path)).collect() == []


def test_a_repeated_attempt_leaves_one_file(tmp_path):
    writer = trees.TreeWriter(str(tmp_path), ["path", "text"], True)
    writer.write(iter([batch([("d/a.json", "first")])]))  # this attempt is lost
    second = writer.write(iter([batch([("d/a.json", "again"), ("b.json", None)])]))
    assert names(tmp_path) == ["a.json", "a.json", "b.json"]  # staged
    writer.commit([second])
    assert names(tmp_path) == ["a.json", "b.json"]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(trees._JOB)]
    assert next(tmp_path.rglob("a.json")).read_text() == "again"


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "path string, text string")
    trees.write_tree(rows, str(tmp_path))
    bad = rows.unionByName(spark.createDataFrame([("../c.txt", "out")], rows.schema))
    with pytest.raises(Exception, match="not a file inside the tree"):
        trees.write_tree(bad.coalesce(1), str(tmp_path))
    with pytest.raises(Exception, match="two rows for the file"):
        trees.write_tree(rows.unionByName(rows).coalesce(1), str(tmp_path))
    assert names(tmp_path) == ["a.txt", "b.txt"] and not (tmp_path.parent / "c.txt").exists()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(trees._JOB)]


def test_append_and_overwrite(spark, tmp_path):
    one = spark.createDataFrame([("a.txt", bytearray(b"\xff"))], "path string, content binary")
    two = spark.createDataFrame([("b.txt", "two")], "path string, text string")
    trees.write_tree(one, f"file://{tmp_path}")
    trees.write_tree(two, str(tmp_path), "append")
    assert names(tmp_path) == ["a.txt", "b.txt"]
    trees.write_tree(two, str(tmp_path))
    assert names(tmp_path) == ["b.txt"]


def reports(spark, tmp_path, **kw):
    files = spark.createDataFrame([("src/a \"q\".py", '{"loc": 3, "by": {"HIGH": 1}}'), ("src/clean.py", None), ("src/b.py", "{}")], "path string, m string")
    files = files.select("path", F.try_parse_json("m").alias("metrics"))
    rows = [("src/a \"q\".py", n, f"B{n}", "it's \"x\"\n" if n % 2 else None) for n in range(5)] + [("src/b.py", 9, "B1", "y")]
    findings = spark.createDataFrame(rows, "path string, pos bigint, test_id string, issue_text string")
    sinks.write_reports(files, findings, "bandit", str(tmp_path))
    return sinks.read_reports(spark, str(tmp_path))


def test_reports_round_trip(spark, tmp_path):
    found = {r.file: r for r in reports(spark, tmp_path).withColumns({"results": F.to_json("results"), "metrics": F.to_json("metrics")}).collect()}
    assert names(tmp_path) == ['bandit_src_a "q".json', "bandit_src_b.json", "bandit_src_clean.json"]
    odd = found['src/a "q".py']
    want = [{"issue_text": "it's \"x\"\n" if n % 2 else None, "test_id": f"B{n}"} for n in range(5)]
    assert json.loads(odd.results) == want and json.loads(odd.metrics) == {"loc": 3, "by": {"HIGH": 1}}
    assert found["src/clean.py"].results == "[]" and found["src/clean.py"].metrics == "{}"
    assert {r.status for r in found.values()} == {"ok"}


def test_results_beyond_a_page_are_further_reports(spark, tmp_path, monkeypatch):
    from lintlake.operators import paging

    pages = lambda df, keys, pos, text, sep, out: paging.text_pages(df, keys, pos, text, sep, out, rows=2)
    monkeypatch.setattr(sinks, "text_pages", pages)
    found = reports(spark, tmp_path).where("file LIKE 'src/a%'").withColumn("n", F.size("results")).collect()
    assert sorted((r.report, r.n) for r in found) == [('bandit_src_a "q".1.json', 2), ('bandit_src_a "q".2.json', 1), ('bandit_src_a "q".json', 2)]


def test_broken_reports_are_failed(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"results": [')
    (tmp_path / "none.json").write_text("")
    (tmp_path / "other.json").write_text('{"metrics": {}}')
    (tmp_path / "fine.json").write_text('{"results": []}')
    got = {r.report: r.status for r in sinks.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"bad.json": "failed", "none.json": "failed", "other.json": "failed", "fine.json": "ok"}
