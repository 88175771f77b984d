"""Ranks and pages do not depend on page size, partitioning or skew."""

import random

from pyspark.sql import functions as F

from lintlake.operators import paging


def skewed(spark, rows=600):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, f"n{rng.randrange(10**6):06d}-{i}") for i in range(rows)]
    return data, spark.createDataFrame(data, "k string, pos bigint, name string").repartition(7)


def test_positions(spark):
    data, df = skewed(spark)
    for rows in (1, 10, 65536):
        got = {(r.k, r.pos): r["rank"] for r in paging.positions(df, ["k"], "pos", rows=rows).collect()}
        want = {}
        for k in {d[0] for d in data}:
            want.update({(k, p): i for i, p in enumerate(sorted(d[1] for d in data if d[0] == k))})
        assert got == want


def test_sorted_positions(spark):
    data, df = skewed(spark)
    got = {(r.k, r.name): r["rank"] for r in paging.sorted_positions(df, ["k"], ["name"]).collect()}
    for k in {d[0] for d in data}:
        names = sorted(d[2] for d in data if d[0] == k)
        assert [got[(k, n)] for n in names] == list(range(len(names)))


def test_pages_follow_each_other(spark):
    data, df = skewed(spark)
    pages = paging.sorted_text_pages(df, ["k"], ["name"], "name", ",", rows=7).collect()
    for k in {d[0] for d in data}:
        mine = sorted((r.page, r.text) for r in pages if r.k == k)
        names = sorted(d[2] for d in data if d[0] == k)
        assert [p for p, _ in mine] == list(range((len(names) + 6) // 7))
        assert ",".join(t for _, t in mine) == ",".join(names)
        assert all(t.count(",") < 7 for _, t in mine)


def test_sparse_positions_share_a_page(spark):
    rows = [(f"k{i % 3}", i * 10**9 + 7, f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos bigint, name string").repartition(5)
    got = {(r.k, r.page): r.text for r in paging.text_pages(df, ["k"], "pos", "name", ",").collect()}
    assert got == {(f"k{j}", 0): ",".join(f"t{i}" for i in range(j, 60, 3)) for j in range(3)}
    for limits in ({"rows": 4}, {"size": 12}):
        pages = paging.text_pages(df, ["k"], "pos", "name", ",", **limits).orderBy("page").collect()
        assert len(pages) >= 15
        for j in range(3):
            assert ",".join(r.text for r in pages if r.k == f"k{j}") == got[(f"k{j}", 0)]


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, i, f"n{i}") for i in range(20)] + [("a", 0, "x")], "k string, pos bigint, name string")
    assert paging.positions(df, ["k"], "pos", rows=6).count() == 21
    for rows in (7, 100):
        pages = paging.sorted_text_pages(df, ["k"], ["name"], "name", ",", rows=rows).orderBy("page").collect()
        assert ",".join(r.text for r in pages if r.k is None) == ",".join(sorted(f"n{i}" for i in range(20)))
        assert [r.text for r in pages if r.k == "a"] == ["x"]


def test_only_large_keys_are_split(spark):
    data, df = skewed(spark)
    pages = paging.sorted_text_pages(df, ["k"], ["name"], "name", ",", rows=100).collect()
    assert {r.k for r in pages if r.page > 0} == {"hot"}
    hot = [r.text for r in sorted(pages, key=lambda r: r.page) if r.k == "hot"]
    assert ",".join(hot) == ",".join(sorted(d[2] for d in data if d[0] == "hot"))
    assert all(t.count(",") < 100 for t in hot)


def test_text_keeps_special_characters(spark):
    df = spark.createDataFrame([("a", 0, "it's"), ("a", 1, "x\\y")], "k string, pos bigint, t string")
    assert paging.text_pages(df, ["k"], "pos", "t", "'\\\n\t").first().text == "it's'\\\n\tx\\y"


def test_empty(spark):
    df = spark.createDataFrame([], "k string, pos bigint, t string")
    assert paging.sorted_text_pages(df, ["k"], ["t"], "t").count() == 0
    assert paging.positions(df.withColumn("x", F.lit(1)), ["k"], "pos").count() == 0


def jobs_of(spark, build):
    """How many jobs ``build`` starts, and what it returns."""
    context, group = spark.sparkContext, f"build-{random.random()}"
    context.setJobGroup(group, "building")
    try:
        made = build()
    finally:
        context.setJobGroup("other", "other")
    return len(context.statusTracker().getJobIdsForGroup(group)), made


def test_building_starts_no_job(spark):
    from lintlake.operators import symbols
    from lintlake.plans import repair

    _, df = skewed(spark)
    files = spark.createDataFrame([("a.py", "import os\nX = 1\n\ndef f():\n    return os, X\n")], "path string, text string")
    placed = files.withColumns({"project": F.lit("p"), "file_id": F.lit(1)})
    functions = spark.createDataFrame([("p", "f", "def f(): 0", 1, 2)], "project string, name string, code string, first_file int, first_pos int")
    plans = [
        lambda: paging.sorted_positions(df, ["k"], ["name"]),
        lambda: paging.sorted_text_pages(df, ["k"], ["name"], "name", ",", rows=7),
        lambda: symbols.main_block(functions),
        lambda: repair.sections(files),
        lambda: repair.organised(files),
        lambda: repair.combined(placed),
        lambda: repair.consolidated(functions.selectExpr("project AS path", "name AS section", "code")),
    ]
    for build in plans:
        started, made = jobs_of(spark, build)
        assert started == 0
        assert made.count() > 0


def test_sorted_pages_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(paging, "SLICE_ROWS", 4)
    data, df = skewed(spark)
    pages = paging.sorted_text_pages(df, ["k"], ["name"], "name", ",", size=200).collect()
    for k in {d[0] for d in data}:
        mine = sorted((r.page, r.text) for r in pages if r.k == k)
        assert ",".join(t for _, t in mine) == ",".join(sorted(d[2] for d in data if d[0] == k))
    assert len([r for r in pages if r.k == "hot"]) > 5


def test_a_changed_table_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for text in ("old", "new"):
        spark.createDataFrame([("a", text)], "k string, t string").write.mode("overwrite").parquet(path)
        assert paging.sorted_text_pages(spark.read.parquet(path), ["k"], ["t"], "t").first().text == text


def test_small_keys_are_not_ranked(spark):
    """Neither joined nor ranked by slices, unless some key is larger than a page."""
    rows = [("a", 1, "x"), ("a", 0, "y"), (None, 7, "z"), ("b", 5, None)]
    df = spark.createDataFrame(rows, "k string, pos bigint, t string")
    pages = paging.small_text_pages(df, ["k"], "pos", "t")
    assert {tuple(r) for r in pages.collect()} == {("a", 0, "y\nx"), (None, 0, "z"), ("b", 0, None)}
    final = pages._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "Window" not in final and "SortMergeJoin" not in final
    cut = paging.small_text_pages(df, ["k"], "pos", "t", rows=1).collect()
    assert {tuple(r) for r in cut} == {("a", 0, "y"), ("a", 1, "x"), (None, 0, "z"), ("b", 0, None)}


def test_a_key_of_just_the_bytes_of_a_page(spark):
    df = spark.createDataFrame([("a", 0, "xy"), ("a", 600, ""), ("b", 0, "x")], "k string, pos bigint, t string")
    pages = paging.small_text_pages(df, ["k"], "pos", "t", size=2).collect()
    assert {tuple(r) for r in pages} == {("a", 0, "xy"), ("a", 1, ""), ("b", 0, "x")}
