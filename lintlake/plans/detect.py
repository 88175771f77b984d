"""Scan a tree: classify every file, find rule hits, write reports, list verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import findings as fi
from lintlake.operators import rules, scoring
from lintlake.sources import corpus, sinks


@dataclass(frozen=True)
class Detection:
    verdicts: DataFrame  # path, verdict
    findings: DataFrame  # the unified layout
    report: DataFrame  # verdicts with their findings and the report name of each file


def detect(
    files: DataFrame,
    scorer: Callable[[pd.Series], np.ndarray],
    rule_set: Sequence[rules.LineRule],
    run: str = "A",
) -> Detection:
    """Detection over ``path, text``; lazy."""
    verdicts = scoring.verdict_map(scoring.classify(files, scorer, ["path"]))
    findings = fi.unified(rules.scan_lines(files, rule_set, ["path"]), "dodgy", F.lit(run))
    report = scoring.detector_output(verdicts, findings).withColumn("report", tx.report_path(F.col("path"), "dodgy"))
    return Detection(verdicts, findings, report)


def detect_tree(
    spark: SparkSession,
    root: str,
    scorer: Callable[[pd.Series], np.ndarray],
    rule_set: Sequence[rules.LineRule],
    reports: str | None = None,
    run: str = "A",
) -> Detection:
    """Detection over the ``.py`` files below ``root``; writes the findings to ``reports`` if given."""
    found = detect(corpus.corpus_scan(spark, root).select("path", "text"), scorer, rule_set, run)
    if reports:
        sinks.write_findings(found.findings, reports)
    return found
