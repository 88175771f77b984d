"""Classifier output, a built-in weighted scorer, verdict tables and detection quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import NON_SPACE, SPACE

WINDOW_TOKENS = 512

# What a label reads as: fixed values.
INSECURE_MESSAGE = "Insecure code detected. Please review and apply necessary security measures."
SECURE_MESSAGE = "No obvious vulnerabilities detected. However, further manual review is recommended."


def argmax(logits: Column) -> Column:
    """Index of the largest value; the first one wins a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def verdict_message(label: Column) -> Column:
    return F.when(label == 1, F.lit(INSECURE_MESSAGE)).otherwise(F.lit(SECURE_MESSAGE))


def yes_no(label: Column) -> Column:
    return F.when(label == 1, F.lit("YES")).otherwise(F.lit("NO"))


def token_windows(
    files: DataFrame, keys: Sequence[str], text: str = "text", tokens: int = WINDOW_TOKENS
) -> DataFrame:
    """``keys, window``: each text cut into windows of at most ``tokens`` whitespace tokens.

    The windows are slices of the unchanged text: joined, they give it back. Space belongs to the
    token after it, space at the end to the last one. A null or blank text is one window.
    """
    words = rf"(?U)(?:{SPACE}*+{NON_SPACE}++){{1,{tokens}}}(?:{SPACE}+\z)?|\A{SPACE}*\z"
    windows = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(words), F.lit(0))
    return files.select(*keys, F.explode(windows).alias("window"))


def classify(
    files: DataFrame,
    scorer: Callable[[pd.Series], np.ndarray],
    keys: Sequence[str],
    text: str = "text",
    tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """``keys, windows, label``: a file is insecure when one of its windows is.

    ``scorer`` turns a batch of texts into a ``(n, labels)`` array of logits. A
    model sees at most ``tokens`` tokens at a time, so a long file is scored
    window by window instead of being cut; a file of one window gets exactly the
    model's own label.
    """

    @F.pandas_udf("array<float>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(scorer(batch), dtype=np.float32)))

    scored = token_windows(files, keys, text, tokens).select(*keys, argmax(logits("window")).alias("_label"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.when(F.max((F.col("_label") == 1).cast("int")) == 1, F.lit(1)).otherwise(F.max("_label")).alias("label"),
    )


def weighted_scores(
    files: DataFrame, weights: DataFrame, keys: Sequence[str], threshold: float, text: str = "text"
) -> DataFrame:
    """``keys, score, label``: sum of token weights, label 1 from ``threshold`` on.

    Weights count to ten decimal places and are summed as decimals, so neither the order of the rows nor
    the kind of join changes a score. Spark broadcasts a weight table that its size estimate allows and
    shuffles otherwise, where AQE splits frequent tokens.
    """
    words = files.select(*keys, F.explode_outer(F.split(F.lower(F.col(text)), rf"(?U){SPACE}+")).alias("token"))
    exact = weights.select("token", F.col("weight").cast("decimal(20,10)").alias("weight"))
    weighed = words.join(exact, "token", "left").select(*keys, "weight")
    score = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0))
    return weighed.groupBy(*keys).agg(F.sum("weight").alias("_sum")).select(
        *keys, score.alias("score"), (score >= threshold).cast("int").alias("label")
    )


def verdict_map(labelled: DataFrame, path: str = "path", label: str = "label") -> DataFrame:
    """``path, verdict``."""
    return labelled.select(path, yes_no(F.col(label)).alias("verdict"))


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """One row: files, insecure files."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict") == "YES").alias("insecure_files")
    )


def detector_output(verdicts: DataFrame, findings: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Verdicts left-joined with findings.

    Written as matches plus files without a match: in an inner join the findings
    of one huge file can be split over tasks, in a left join they cannot.
    """
    matched = findings.join(verdicts, list(keys))
    reported = findings.select(*keys).distinct()
    clean = verdicts.join(reported, list(keys), "left_anti")
    return matched.unionByName(clean, allowMissingColumns=True)


def detection_quality(verdicts: DataFrame, labels: DataFrame, keys: Sequence[str], truth: str) -> DataFrame:
    """One row of counts: true and false positives and negatives over the labelled files."""
    said, is_so = F.col("verdict") == "YES", F.col(truth) == 1
    return verdicts.join(labels.select(*keys, truth), list(keys)).agg(
        F.count_if(said & is_so).alias("true_positives"),
        F.count_if(said & ~is_so).alias("false_positives"),
        F.count_if(~said & is_so).alias("false_negatives"),
        F.count_if(~said & ~is_so).alias("true_negatives"),
    )
