"""A corpus followed through its drops is as the last drop scanned as a whole."""

from pyspark.sql import functions as F

from lintlake.operators.rules import LineRule, scan_verdicts
from lintlake.streaming import changes, jobs

RULES = [LineRule("key", "key=[0-9]+", "Key", "key=")]
SCHEMA = "path string, text string, drop long"


def scan(files):
    return scan_verdicts(files, RULES, ["path"])


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def expected(spark, files):
    made = spark.createDataFrame(files, "path string, text string")
    return rows(scan(made.dropDuplicates(["path"])))


def followed(spark, root, drops, one_by_one=True):
    """Write the drops; run the stream after each of them, or after all."""
    for n, files in enumerate(drops):
        spark.createDataFrame(files, SCHEMA).coalesce(1).write.parquet(f"{root}/in/n={n}")
        if one_by_one or n == len(drops) - 1:
            stream = jobs.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], SCHEMA).schema)
            changes.scan_changes(stream, f"{root}/out", scan, ["path"]).awaitTermination()
    schema = scan(spark.createDataFrame([], SCHEMA)).schema
    return changes.current_results(spark, f"{root}/out", schema, ["path"])


FIRST = [("a", "key=1", 0), ("b", "clean", 0), ("c", "key=2\nkey=3", 0), (None, "key=4", 0), ("n", None, 0)]
SECOND = [("a", "key=1", 1), ("b", "key=9", 1), (None, "key=5", 1), ("n", None, 1), ("a", "key=1", 1)]
THIRD = [("a", "key=1", 2), ("b", "key=9", 2), ("c", "key=2\nkey=3", 2), (None, "key=5", 2), ("d", "", 2), ("e", "key=7", 2), ("e", "key=7", 2)]


def test_last_drop_counts(spark, tmp_path):
    got = followed(spark, tmp_path, [FIRST, SECOND, THIRD])
    assert rows(got) == expected(spark, [f[:2] for f in THIRD])
    counts = {r.batch_id: (r.files, r.added, r.changed, r.same) for r in changes.batch_counts(spark, f"{tmp_path}/out").collect()}
    assert counts == {0: (5, 5, 0, 0), 1: (5, 0, 2, 2), 2: (7, 2, 0, 4)}
    scanned = spark.read.parquet(f"{tmp_path}/out/results").groupBy("batch_id").count()
    assert rows(scanned) == [("0", "5"), ("1", "2"), ("2", "2")]  # nothing is scanned twice, though c came back


def test_files_that_went_away_have_no_rows(spark, tmp_path):
    got = followed(spark, tmp_path, [FIRST, SECOND])
    assert rows(got) == expected(spark, list({f[:2] for f in SECOND}))


def test_drops_at_once_and_out_of_order(spark, tmp_path):
    at_once = followed(spark, f"{tmp_path}/x", [FIRST, SECOND, THIRD], one_by_one=False)
    late = followed(spark, f"{tmp_path}/y", [SECOND, THIRD, FIRST])
    assert rows(at_once) == rows(late) == expected(spark, [f[:2] for f in THIRD])


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    for batch_id, files in enumerate([FIRST, SECOND, SECOND]):
        batch_id = min(batch_id, 1)  # the last one is a retry
        changes.take_in(spark.createDataFrame(files, SCHEMA), batch_id, root, scan, ["path"], "text", "drop")
    schema = scan(spark.createDataFrame([], SCHEMA)).schema
    assert rows(changes.current_results(spark, root, schema, ["path"])) == expected(spark, list({f[:2] for f in SECOND}))
    assert changes.batch_counts(spark, root).count() == 2


def test_an_unfinished_batch_did_not_happen(spark, tmp_path):
    root, seen = f"{tmp_path}/out", spark.createDataFrame(FIRST, SCHEMA)
    changes.take_in(seen, 0, root, scan, ["path"], "text", "drop")
    torn = changes.merged_state(spark.read.parquet(f"{root}/state/batch_id=0"), seen.select("path", F.lit(8).cast("long").alias("drop"), F.lit("x").alias("hash")), ["path"], 1)
    torn.write.parquet(f"{root}/state/batch_id=1")  # no results, no counts
    schema = scan(spark.createDataFrame([], SCHEMA)).schema
    assert rows(changes.current_results(spark, root, schema, ["path"])) == expected(spark, [f[:2] for f in FIRST])
    changes.take_in(spark.createDataFrame(SECOND, SCHEMA), 1, root, scan, ["path"], "text", "drop")
    assert rows(changes.current_results(spark, root, schema, ["path"])) == expected(spark, list({f[:2] for f in SECOND}))


def test_nothing_yet(spark, tmp_path):
    schema = scan(spark.createDataFrame([], SCHEMA)).schema
    assert changes.current_results(spark, f"{tmp_path}/out", schema, ["path"]).collect() == []
    got = followed(spark, tmp_path, [[("a", "key=1", None)]])
    assert got.collect() == []
