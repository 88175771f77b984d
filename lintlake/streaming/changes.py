"""A corpus scanned again and again: only new and changed files are scanned, files that went away are retracted.

Files come in numbered drops, each a complete listing of the corpus. Per file the state keeps the newest drop that
listed it, the hash of its content there, and the micro-batch that scanned that content. Below ``root``:

* ``state/batch_id=N``: the state after micro-batch N, one small row per file;
* ``results/batch_id=N``: scan results of the contents that were new in N;
* ``done/batch_id=N``: one row of counts, written last; a micro-batch without it did not happen.

A retried micro-batch starts from the same state before it and replaces its own folders. A drop may be spread over
several micro-batches, and drops may come out of order: a file's newest drop counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"
Scan = Callable[[DataFrame], DataFrame]

_FACTS = [
    T.StructField("drop", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("scanned", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()),
]
_DONE = "drop long, files long, added long, changed long, same long, batch_id long"


def _state_before(spark: SparkSession, root: str, batch_id: int, keys: T.StructType) -> DataFrame:
    """The state the last finished micro-batch before ``batch_id`` left."""
    schema = T.StructType([*keys.fields, *_FACTS])
    last = _last_done(spark, root, batch_id)
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/state/{BATCH}={last[BATCH]}")


def _last_done(spark: SparkSession, root: str, before: int | None = None):  # noqa: ANN202
    """The row of the last finished micro-batch; None when there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/done")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    done = spark.read.schema(_DONE).parquet(f"{root}/done")
    done = done if before is None else done.where(F.col(BATCH) < before)
    return done.orderBy(F.desc(BATCH)).first()  # one row


def merged_state(before: DataFrame, listed: DataFrame, keys: Sequence[str], batch_id: int) -> DataFrame:
    """``keys, drop, hash, scanned, status, rows``: the state after the rows ``keys, drop, hash`` of a micro-batch.

    ``status`` is ``added``, ``changed``, ``same``, or ``unlisted`` for files the micro-batch does not name (or names
    in an older drop only). Of two contents of a file in one drop the one with the larger hash counts. Only keys,
    numbers and hashes are shuffled. Null keys are a key. ``rows`` counts a file's rows in the micro-batch.
    """
    key = F.struct(*keys)
    latest = F.max(F.struct("drop", F.coalesce("hash", F.lit("")).alias("_h"), "hash")).alias("_new")
    newest = listed.groupBy(key.alias("_key")).agg(latest, F.count(F.lit(1)).alias("rows"))
    old = before.select(key.alias("_key"), F.struct("drop", "hash", "scanned").alias("_old"))
    both = newest.join(old, newest["_key"].eqNullSafe(old["_key"]), "full")
    unlisted = F.col("_new").isNull() | (F.col("_new.drop") < F.col("_old.drop"))
    same = F.col("_new.hash").eqNullSafe(F.col("_old.hash"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.coalesce(unlisted, F.lit(False)), "unlisted")
        .when(same, "same")
        .otherwise("changed")
    )
    facts = both.select(F.coalesce(newest["_key"], old["_key"]).alias("_key"), "_new", "_old", status.alias("status"), "rows")
    fresh, left = F.col("status").isin("added", "changed"), F.col("status") == "unlisted"
    return facts.select(
        "_key.*",
        F.when(left, F.col("_old.drop")).otherwise(F.col("_new.drop")).alias("drop"),
        F.when(left, F.col("_old.hash")).otherwise(F.col("_new.hash")).alias("hash"),
        F.when(fresh, F.lit(batch_id).cast("long")).otherwise(F.col("_old.scanned")).alias("scanned"),
        "status",
        "rows",
    )


def take_in(batch: DataFrame, batch_id: int, root: str, scan: Scan, keys: Sequence[str], text: str, drop: str) -> None:
    """One micro-batch: new state, results of the new contents, counts."""
    spark = batch.sparkSession
    files = batch.select(*keys, F.col(drop).cast("long").alias("drop"), F.sha2(text, 256).alias("hash"), F.col(text))
    files = files.where(F.col("drop").isNotNull())
    key_types = T.StructType([files.schema[k] for k in keys])
    state = merged_state(_state_before(spark, root, batch_id, key_types), files.drop(text), keys, batch_id)
    state.write.mode("overwrite").parquet(f"{root}/state/{BATCH}={batch_id}")
    # read again: Spark knows how large it is, and sends few changed files to all tasks
    state = spark.read.schema(state.schema).parquet(f"{root}/state/{BATCH}={batch_id}")
    places = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    wanted = state.where(F.col("status").isin("added", "changed"))
    wanted = wanted.select(*places, F.col("drop").alias("_d"), F.col("hash").alias("_h"), "rows")
    met = [files[k].eqNullSafe(wanted[f"_{i}"]) for i, k in enumerate(keys)]
    met += [files["drop"] == wanted["_d"], files["hash"].eqNullSafe(wanted["_h"])]
    once = files.join(wanted, [*met, wanted["rows"] == 1], "left_semi")
    several = files.join(wanted, [*met, wanted["rows"] > 1], "left_semi").dropDuplicates([*keys])  # only these are shuffled
    fresh = once.unionByName(several).select(*keys, text)
    scan(fresh).write.mode("overwrite").parquet(f"{root}/results/{BATCH}={batch_id}")
    count = lambda name: F.count_if(F.col("status") == name).alias(name)
    counts = state.agg(F.max("drop").alias("drop"), F.count(F.lit(1)).alias("files"), count("added"), count("changed"), count("same"))
    counts.write.mode("overwrite").parquet(f"{root}/done/{BATCH}={batch_id}")


def scan_changes(
    stream: DataFrame, root: str, scan: Scan, keys: Sequence[str], text: str = "text", drop: str = "drop", available_now: bool = True
) -> StreamingQuery:
    """Follow a stream ``keys, drop, text``; ``scan`` maps files ``keys, text`` to rows that hold ``keys``.

    ``keys`` identify a file. Rows without a drop number are left out. A file without a text is scanned as one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        take_in(batch, batch_id, root, scan, keys, text, drop)

    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_results(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The results (of ``schema``) of all files the newest drop listed: what scanning that drop as a whole gives.

    A file that an earlier drop listed and the newest does not has no rows.
    """
    last = _last_done(spark, root)
    if last is None:
        return spark.createDataFrame([], schema)
    key_types = [schema[k] for k in keys]
    state = spark.read.schema(T.StructType([*key_types, *_FACTS])).parquet(f"{root}/state/{BATCH}={last[BATCH]}")
    live = state.where(F.col("drop") == last["drop"]).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "scanned")
    logged = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    results = spark.read.schema(logged).parquet(f"{root}/results")
    met = [results[k].eqNullSafe(live[f"_{i}"]) for i, k in enumerate(keys)]
    return results.join(live, [*met, results[BATCH] == live["scanned"]], "left_semi").select(*schema.names)


def batch_counts(spark: SparkSession, root: str) -> DataFrame:
    """``batch_id, drop, files, added, changed, same`` per finished micro-batch; ``files`` counts all ever listed."""
    return spark.read.schema(_DONE).parquet(f"{root}/done")
