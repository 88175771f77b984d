"""The repair loop over a whole corpus: prompt, complete, fix, scan, until every section has stopped.

A round is one job over the *frontier*, the sections that have not stopped. What a round finds out is
written before the next one reads it, so a model is asked once per prompt however often tasks are
run again, and a lost executor costs tasks, not rounds. Every section leaves the frontier at its own round:

* without a code block it stops with no code,
* when its import-fixed code passes all gating scans it stops with that code,
* at the allowance it stops with its last raw block.

The model, the scanners and the import fixer are given as functions over DataFrames, so they may be
Pandas UDFs, built-in expressions or joins with stored results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import findings as fi
from lintlake.operators import prompts as pr
from lintlake.session import shared_path

SECTION = ("path", "section")
ROUND = (*SECTION, "iteration")
SIZES = ("_lines", "_words")  # of the original section

#: ``path, section, iteration, code, libraries`` to findings ``path, section, iteration, tool, pos, text``
Scan = Callable[[DataFrame], DataFrame]
#: ``path, section, iteration, page, temperature, messages`` to ``path, section, iteration, page, response``
Complete = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Repaired:
    """``attempts``: path, section, iteration (from 1), code_block, fixed_code, libraries, passed.
    ``resolved``: path, section, iteration, code, passed, status. ``rounds``: how many were run."""

    attempts: DataFrame
    resolved: DataFrame
    rounds: int


def _stored(df: DataFrame, folder: str, name: str, number: int) -> DataFrame:
    path = f"{folder}/{name}/round={number}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stopped(attempts: DataFrame, allowance: int) -> DataFrame:
    """``path, section, iteration, code, passed, status`` of the attempts after which a section stops."""
    missing = F.coalesce("code_block", F.lit("")) == ""
    status = F.when(missing, F.lit("no_code")).when(F.col("passed"), F.lit("passed"))
    status = status.when(F.col("iteration") >= allowance, F.lit("spent"))
    code = F.when(missing, F.lit(None)).when(F.col("passed"), F.col("fixed_code")).otherwise(F.col("code_block"))
    return attempts.select(*ROUND, code.alias("code"), "passed", status.alias("status")).where("status IS NOT NULL")


def one_round(
    frontier: DataFrame,
    findings: DataFrame,
    complete: Complete,
    template: str,
    system: str,
    guidance: Mapping[str, str],
    allowance: int,
    fix: Callable[[Column], Column],
    number: int,
) -> DataFrame:
    """``path, section, iteration, code_block, fixed_code, libraries`` of the next round, and the sizes of the original.

    The frontier carries the sizes of its originals, so that these are counted once. ``libraries`` are those of the code that was prompted with: the scan of a round works with them.
    Findings of more than one page make further prompts; the response to the first one counts, and what
    it leaves is found again by the next scan. A prompt without a response gives no code.
    All sections of a frontier have the same iteration, ``number`` - 1, so tables meet by section: one
    shuffle each, and what is sorted for a join stays so for the aggregates behind it.
    """
    frontier = frontier.withColumn("iteration", F.lit(number - 1))
    pages = fi.issue_pages(fi.gate_security_scans(findings), [*ROUND, "tool"]).repartition(*SECTION)
    rows = pr.prompt_rows(frontier, fi.issue_sections(pages, ROUND), None, template, system, guidance, allowance, SECTION)
    responses = complete(rows).where(F.col("iteration") == number - 1)
    responses = responses.groupBy(*SECTION).agg(F.min_by("response", "page").alias("response"))
    blocks = responses.select(*SECTION, F.nullif(tx.extract_code_block(F.col("response")), F.lit("")).alias("code_block"))
    before = frontier.select(*SECTION, *SIZES, tx.extract_libraries(F.col("code")).alias("libraries"))
    block = F.col("code_block")
    return before.join(blocks, list(SECTION), "left").select(
        *SECTION,
        F.lit(number).alias("iteration"),
        "code_block",
        F.when(block.isNotNull(), fix(block)).alias("fixed_code"),
        "libraries",
        *SIZES,
    )


def repair_corpus(
    sections: DataFrame,
    scan: Scan,
    complete: Complete,
    template: str,
    system: str,
    guidance: Mapping[str, str],
    allowance: int,
    fix: Callable[[Column], Column] = lambda code: code,
    folder: str | None = None,
) -> Repaired:
    """Repair every section of ``path, section, code``.

    The originals are scanned first (iteration 0) and prompted with even if they are clean. The tables of all rounds go
    below ``folder`` (a fresh path in the shared folder unless given). A section without code counts as
    empty code; of sections of one key the last in text order counts. Other columns are left behind.
    """
    if allowance < 1:
        raise ValueError("a repair needs an allowance of one round at least")
    folder = folder or shared_path(sections.sparkSession, "repair")
    originals = sections.select(*SECTION, "code").repartition(*SECTION).groupBy(*SECTION).agg(F.coalesce(F.max("code"), F.lit("")).alias("code"))
    originals = _stored(pr.with_sizes(originals), folder, "originals", 0)
    frontier = originals.withColumn("iteration", F.lit(0))
    libraries = tx.extract_libraries(F.col("code")).alias("libraries")
    findings = _stored(scan(frontier.select(*ROUND, "code", libraries)).select(*ROUND, "tool", "pos", "text"), folder, "findings", 0)
    rounds = []
    for number in range(1, allowance + 1):
        made = one_round(frontier, findings, complete, template, system, guidance, allowance, fix, number)
        made = _stored(made, folder, "responses", number)
        coded = made.where("code_block IS NOT NULL").select(*ROUND, F.col("fixed_code").alias("code"), "libraries")
        findings = _stored(scan(coded).select(*ROUND, "tool", "pos", "text"), folder, "findings", number)
        clean = fi.verdicts(coded, fi.gate_security_scans(findings), ROUND)
        attempts = made.join(clean, list(ROUND), "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
        rounds.append(_stored(attempts, folder, "attempts", number))
        frontier = rounds[-1].where("code_block IS NOT NULL AND NOT passed").select(*ROUND, *SIZES, F.col("fixed_code").alias("code"))
        if number == allowance or frontier.isEmpty():
            break
    attempts = reduce(DataFrame.unionByName, rounds).drop(*SIZES)
    return Repaired(attempts, stopped(attempts, allowance), len(rounds))
