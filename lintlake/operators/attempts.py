"""Repair attempts as tables: schedules, resolution, carry-over, run labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import budget
from lintlake.functions import text as tx

KEYS = ("path", "section")


def schedule(files: DataFrame, allowance: int, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rows ``0..allowance-1`` per file with the size and temperature of each round. The text stays behind."""
    sized = files.select(
        *keys, budget.line_count(F.col(text)).alias("_lines"), budget.word_count(F.col(text)).alias("_words")
    )
    rounds = F.sequence(F.lit(0), F.lit(allowance - 1))
    i, n = F.col("iteration"), F.lit(allowance)
    return sized.select(*keys, "_lines", "_words", F.explode(rounds).alias("iteration")).select(
        *keys,
        "iteration",
        budget.line_budget(F.col("_lines"), n, i).alias("line_count"),
        budget.word_budget(F.col("_words"), n, i).alias("word_count"),
        budget.temperature(n, i).alias("temperature"),
    )


def resolve(attempts: DataFrame, allowance: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, iteration, code, passed, status`` per section.

    The walk stops at the first attempt without code (``no_code``), at the first
    that passes (its import-fixed code counts), or at the allowance (``spent``,
    its raw code counts). A section that has not stopped yet is ``open``. One
    aggregate; a section with very many attempts is reduced on the map side.
    """
    missing = F.coalesce(F.col("code_block"), F.lit("")) == ""
    passed = ~missing & F.coalesce(F.col("passed"), F.lit(False))
    stops = missing | passed | (F.col("iteration") >= allowance)
    outcome = F.struct(
        "iteration",
        F.when(passed, F.col("fixed_code")).otherwise(F.col("code_block")).alias("code"),
        passed.alias("passed"),
        F.when(missing, F.lit("no_code")).when(passed, F.lit("passed")).otherwise(F.lit("spent")).alias("status"),
    )
    # structs compare by their first field, which is unique per section
    first_stop = F.min(F.when((F.col("iteration") >= 1) & stops, outcome))
    return attempts.groupBy(*keys).agg(first_stop.alias("s")).select(
        *keys,
        "s.iteration",
        F.nullif("s.code", F.lit("")).alias("code"),
        F.coalesce("s.passed", F.lit(False)).alias("passed"),
        F.coalesce("s.status", F.lit("open")).alias("status"),
    )


def resolve_tests(runs: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, runs, code``: the original test when one of the first ``limit`` runs passes, otherwise null."""
    ok = tx.test_outcome(F.col("stdout"), F.col("stderr")) & (F.col("iteration") <= limit)
    return runs.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("iteration"))).alias("runs"),
        F.when(F.bool_or(ok), F.min_by("original", "iteration")).alias("code"),
    )


def carried_libraries(
    attempts: DataFrame, originals: DataFrame | None = None, keys: Sequence[str] = KEYS, code: str = "fixed_code"
) -> DataFrame:
    """``keys, iteration, libraries``: the scan of a round uses the libraries of the code saved before it.

    That is the import-fixed code of the round before, or the original (``originals``: ``keys, code``;
    or attempts of iteration 0). Iteration 0 has its own; a round without any code before it has none.
    The round before is found by an equi-join on ``keys + iteration`` (unique),
    not by a window over the section, so a hot section is not one task.
    """
    own = attempts.select(*keys, "iteration", tx.extract_libraries(F.coalesce(code, F.lit(""))).alias("_own"))
    earlier = own
    if originals is not None:
        first = tx.extract_libraries(F.coalesce("code", F.lit(""))).alias("_own")
        earlier = own.filter("iteration > 0").unionByName(originals.select(*keys, F.lit(0).alias("iteration"), first))
    before = earlier.select(*keys, (F.col("iteration") + 1).alias("iteration"), F.col("_own").alias("_before"))
    none = F.array().cast("array<string>")
    return own.join(before, [*keys, "iteration"], "left").select(
        *keys,
        "iteration",
        F.when(F.col("iteration") == 0, F.col("_own")).otherwise(F.coalesce("_before", none)).alias("libraries"),
    )


def run_labels(manifest: DataFrame, name: str = "name", run: str = "run") -> DataFrame:
    """``name, earlier_runs, label``: the label the next run of each script gets."""
    counted = manifest.groupBy(name).agg(F.count_distinct(run).alias("earlier_runs"))
    return counted.select(name, "earlier_runs", budget.run_label(F.col("earlier_runs")).alias("label"))


def attempt_paths(attempts: DataFrame, base: Column, section: Column, ext: Column) -> DataFrame:
    return attempts.withColumn("attempt_path", tx.attempt_path(base, section, F.col("iteration"), ext))
