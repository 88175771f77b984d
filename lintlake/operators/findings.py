"""Findings: one table for all tools, de-duplication, roll-up, verdicts, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import formats
from lintlake.functions.text import strip
from lintlake.operators.paging import small_text_pages

SECURITY_TOOLS = ("bandit", "dodgy", "semgrep")
GATE_TOOLS = (*SECURITY_TOOLS, "mypy")
TEST_MARK = "unit_test"

# Prompt headings and sentences: fixed values.
SECURITY_HEADING = "**Adhere to Best Security Practices:**"
LINTER_HEADING = "**Adhere to These Linter Findings:**"
TOOL_INTRO = "{tool} has identified the following issues in the provided Python code:\n"


# -- one table ---------------------------------------------------------------


def unified(findings: DataFrame, tool: str, run: Column | None = None) -> DataFrame:
    """One tool's rows in the shared layout; fields only that tool has go to ``attrs``."""
    has = set(findings.columns)

    def first_of(*names: str) -> Column:
        return next((F.col(n) for n in names if n in has), F.lit(None))

    extras = {
        "bandit": {"line_range": lambda: formats.int_list(F.col("line_range"))},
        "dodgy": {"variable_name": lambda: F.col("variable_name")},
        "semgrep": {
            "owasp": lambda: F.array_join("owasp", ", "),
            "cwe": lambda: F.array_join("cwe", ", "),
        },
        "vulture": {"type": lambda: F.col("type")},
    }.get(tool, {})
    attrs = [part for name, make in extras.items() if name in has for part in (F.lit(name), make())]
    return findings.select(
        "path",
        (run if run is not None else first_of("run")).cast("string").alias("run"),
        F.lit(tool).alias("tool"),
        F.col("pos").cast("bigint").alias("pos"),
        first_of("test_id", "rule_id").cast("string").alias("rule_id"),
        first_of("line_number", "line").cast("bigint").alias("line"),
        first_of("issue_text", "reason", "message", "name").cast("string").alias("message"),
        (F.create_map(*attrs) if attrs else F.create_map()).cast("map<string,string>").alias("attrs"),
    )


def union_tools(parts: dict[str, DataFrame], run: Column | None = None) -> DataFrame:
    """Findings of several tools in one table."""
    return reduce(DataFrame.unionByName, [unified(df, tool, run) for tool, df in parts.items()])


def union_rulesets(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("path",)) -> DataFrame:
    """Results of several rulesets in ruleset order, duplicates removed (first kept)."""
    rows = reduce(
        DataFrame.unionByName,
        [df.withColumn("ruleset_pos", F.lit(i)) for i, (_, df) in enumerate(parts)],
    )
    return drop_duplicate_findings(
        rows.withColumn("pos", F.struct("ruleset_pos", F.col("pos").cast("bigint").alias("pos"))), keys
    )


def drop_duplicate_findings(
    findings: DataFrame, keys: Sequence[str] = ("path",), fields: Sequence[str] = ("line", "message", "owasp", "cwe")
) -> DataFrame:
    """Equal findings collapse to the first one's position."""
    return findings.groupBy(*keys, *fields).agg(F.min("pos").alias("pos"))


def collapse_rules(
    findings: DataFrame,
    keys: Sequence[str] = ("path",),
    rule: str = "test_id",
    details: Sequence[str] = ("line_number", "line_range", "issue_text"),
) -> DataFrame:
    """One row per rule: the last occurrence's details at the first occurrence's position."""
    return (
        findings.groupBy(*keys, rule)
        .agg(F.max_by(F.struct(*details), F.col("pos")).alias("_last"), F.min("pos").alias("pos"))
        .select(*keys, rule, "pos", "_last.*")
    )


def gate_security_scans(findings: DataFrame, path: str = "path", tool: str = "tool") -> DataFrame:
    """Generated tests are only type-checked: their security findings are left out."""
    skipped = F.contains(F.col(path), F.lit(TEST_MARK)) & F.col(tool).isin(*SECURITY_TOOLS)
    return findings.filter(~skipped)


# -- roll-up and verdict -----------------------------------------------------


def issue_pages(findings: DataFrame, keys: Sequence[str] = ("path", "tool"), text: str = "text") -> DataFrame:
    """``keys, page, summary``: rendered findings joined by newlines in ``pos`` order."""
    return small_text_pages(findings, keys, "pos", text, "\n", "summary")


def summaries(
    files: DataFrame,
    pages: DataFrame,
    keys: Sequence[str] = ("path",),
    tools: Sequence[str] = GATE_TOOLS,
) -> DataFrame:
    """Every file with every tool; a clean pair gets page 0 with the sentinel."""
    grid = files.select(*keys, F.explode(F.array(*[F.lit(t) for t in tools])).alias("tool"))
    return grid.join(pages, [*keys, "tool"], "left").select(
        *keys,
        "tool",
        F.coalesce("page", F.lit(0)).cast("bigint").alias("page"),
        F.coalesce("summary", formats.no_issues(F.col("tool"))).alias("summary"),
    )


def verdicts(
    files: DataFrame,
    findings: DataFrame,
    keys: Sequence[str] = ("path",),
    failed: DataFrame | None = None,
) -> DataFrame:
    """``keys, passed``: a file passes when no gating tool reported anything or failed.

    One shuffle: the file list and the findings meet in a single aggregate whose
    map side already reduces a heavily reported file to one row per task.
    """
    rows = files.select(*keys, F.lit(True).alias("listed"), F.lit(True).alias("clean"))
    bad = [findings.filter(F.col("tool").isin(*GATE_TOOLS))] + ([failed] if failed is not None else [])
    for df in bad:
        rows = rows.unionByName(df.select(*keys, F.lit(False).alias("listed"), F.lit(False).alias("clean")))
    return (
        rows.groupBy(*keys)
        .agg(F.bool_or("listed").alias("listed"), F.bool_and("clean").alias("passed"))
        .filter("listed")
        .drop("listed")
    )


def metrics(findings: DataFrame, levels: Sequence[str] = ("tool", "path", "rule_id")) -> DataFrame:
    """Finding counts per level and for every roll-up of the levels.

    Counted once at the finest level, so the roll-up expands counts, not findings.
    """
    finest = findings.groupBy(*levels).agg(F.count(F.lit(1)).alias("_n"))
    return finest.rollup(*levels).agg(
        F.sum("_n").alias("findings"), F.grouping_id().cast("bigint").alias("level")
    )


# -- prompt sections ---------------------------------------------------------


def issue_sections(summary_rows: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``keys, page, issues``: the issue part of a prompt, empty tools and headings dropped."""

    def body(tool: str) -> Column:
        return F.max(F.when((F.col("tool") == tool) & (F.col("summary") != formats.NO_ISSUES), F.col("summary")))

    def section(tool: str) -> Column:
        intro = TOOL_INTRO.format(tool=tool.capitalize())
        return F.coalesce(F.concat(F.lit("\n" + intro), F.col(f"_{tool}"), F.lit("\n\n")), F.lit(""))

    wide = summary_rows.groupBy(*keys, "page").agg(*[body(t).alias(f"_{t}") for t in GATE_TOOLS])
    security = F.concat(*[section(t) for t in SECURITY_TOOLS])
    linter = section("mypy")
    joined = F.concat(
        F.when(security == "", F.lit("")).otherwise(F.concat(F.lit(SECURITY_HEADING), security)),
        F.lit("\n\n"),
        F.when(linter == "", F.lit("")).otherwise(F.concat(F.lit(LINTER_HEADING), linter)),
        F.lit("\n\n"),
    )
    return wide.select(*keys, "page", strip(joined).alias("issues"))


# -- comparisons -------------------------------------------------------------


def corroborated(findings: DataFrame, keys: Sequence[str] = ("path", "line"), tools: int = 2) -> DataFrame:
    """Findings whose place is reported by at least ``tools`` different tools."""
    places = (
        findings.groupBy(*keys).agg(F.count_distinct("tool").alias("_tools")).filter(F.col("_tools") >= tools)
    )
    return findings.join(places.select(*keys), list(keys), "left_semi")


def compare_attempts(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = ("path", "tool", "rule_id", "line")
) -> DataFrame:
    """``keys, status``: fixed, kept or new. One aggregate instead of a full outer join."""
    both = before.select(*keys, F.lit(0).alias("_side")).unionByName(after.select(*keys, F.lit(1).alias("_side")))
    return both.groupBy(*keys).agg(
        F.when(F.max("_side") == 0, F.lit("fixed"))
        .when(F.min("_side") == 1, F.lit("new"))
        .otherwise(F.lit("kept"))
        .alias("status")
    )




def compare_first_last(
    attempts: DataFrame,
    findings: DataFrame,
    keys: Sequence[str] = ("path", "section"),
    identity: Sequence[str] = ("tool", "rule_id", "line"),
) -> DataFrame:
    """``keys, identity, status`` between the first and the last attempt of each section.

    The attempts say which ones those are, so a clean last attempt makes every
    earlier finding ``fixed``.
    """
    ends = attempts.groupBy(*keys).agg(F.min("iteration").alias("_first"), F.max("iteration").alias("_last"))
    in_first, in_last = F.col("iteration") == F.col("_first"), F.col("iteration") == F.col("_last")
    at_ends = findings.join(ends, list(keys)).filter(in_first | in_last)
    return at_ends.groupBy(*keys, *identity).agg(
        F.when(F.bool_or(in_first) & F.bool_or(in_last), F.lit("kept"))
        .when(F.bool_or(in_first), F.lit("fixed"))
        .otherwise(F.lit("new"))
        .alias("status")
    )
