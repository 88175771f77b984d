"""Scanner reports to finding rows.

Each ``*_findings`` function takes a table with one report per row and keeps the
``keys`` columns; each ``read_*`` function reads report files. ``pos`` is the
position inside the report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import text as tx


def _read_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.col("_metadata.file_path").alias("report"), F.col("value"))
    )


def report_status(reports: DataFrame, column: str) -> DataFrame:
    """Adds ``status``: ``failed`` when there is no parseable report. Failed never counts as clean."""
    parsed = F.try_parse_json(F.col(column))
    return reports.withColumn("status", F.when(parsed.isNull(), F.lit("failed")).otherwise(F.lit("ok")))


def bandit_findings(reports: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, test_id, line_number, line_range, issue_text``."""
    parsed = reports.select(*keys, F.from_json(column, schemas.BANDIT_REPORT).alias("r"))
    rows = parsed.select(*keys, F.posexplode("r.results").alias("pos", "f"))
    return rows.select(*keys, "pos", "f.*")


def dodgy_findings(reports: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, line_number, variable_name, reason``; a report without issues adds no row."""
    parsed = reports.select(*keys, F.from_json(column, schemas.DODGY_REPORT).alias("r"))
    rows = parsed.select(*keys, F.posexplode("r.issues").alias("pos", "f"))
    return rows.select(*keys, "pos", "f.*")


def _string_list(metadata: Column, field: str) -> Column:
    """A list field that some rules give as a single string; missing is empty."""
    return F.coalesce(
        F.try_variant_get(metadata, f"$.{field}", "array<string>"),
        F.array(F.try_variant_get(metadata, f"$.{field}", "string")),
    )


def semgrep_standard(result: Column) -> Column:
    """``line, message, owasp, cwe`` of one raw result given as a variant."""
    metadata = F.try_variant_get(result, "$.extra.metadata", "variant")

    def listed(field: str) -> Column:
        return F.filter(_string_list(metadata, field), lambda x: x.isNotNull())

    return F.struct(
        F.try_variant_get(result, "$.start.line", "int").alias("line"),
        F.try_variant_get(result, "$.extra.message", "string").alias("message"),
        F.coalesce(listed("owasp"), F.array().cast("array<string>")).alias("owasp"),
        F.coalesce(listed("cwe"), F.array().cast("array<string>")).alias("cwe"),
    )


def semgrep_results(results: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """One raw result (JSON object) per row to the standard columns."""
    parsed = results.select(*keys, F.try_parse_json(F.col(column)).alias("v"))
    return parsed.select(*keys, semgrep_standard(F.col("v")).alias("f")).select(*keys, "f.*")


def semgrep_findings(reports: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Whole scanner outputs (``{"results": [...]}``) to the standard columns, exploded."""
    results = F.try_variant_get(F.try_parse_json(F.col(column)), "$.results", "array<variant>")
    rows = reports.select(*keys, F.posexplode(results).alias("pos", "v"))
    return rows.select(*keys, "pos", semgrep_standard(F.col("v")).alias("f")).select(*keys, "pos", "f.*")


def typecheck_findings(outputs: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``file:line: message`` lines of a type checker: ``keys, pos, line, message``.

    Lines with fewer than three parts or with a second part that is no whole
    number are not findings. ``pos`` is the line's position in the output.
    """
    lines = outputs.select(*keys, F.posexplode(tx.split_lines(F.col(column))).alias("pos", "out_line"))
    parts = lines.select(*keys, "pos", F.split("out_line", ":", 3).alias("p")).filter(F.size("p") == 3)
    number = tx.strip(F.col("p")[1])
    return (
        parts.filter(number.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"))
        .select(
            *keys,
            "pos",
            F.replace(number, F.lit("_"), F.lit("")).try_cast("bigint").alias("line"),
            tx.strip(F.col("p")[2]).alias("message"),
        )
    )


def unused_code_findings(reports: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``keys, pos, type, name`` with the defaults of missing fields."""
    rows = reports.select(*keys, F.posexplode(F.from_json(column, schemas.UNUSED_CODE)).alias("pos", "f"))
    return rows.select(
        *keys,
        "pos",
        F.coalesce("f.type", F.lit("Unknown")).alias("type"),
        F.coalesce("f.name", F.lit("N/A")).alias("name"),
    )


def read_bandit_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return bandit_findings(_read_reports(spark, paths), "value", ["report"])


def read_dodgy_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return dodgy_findings(_read_reports(spark, paths), "value", ["report"])


def read_semgrep_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return semgrep_findings(_read_reports(spark, paths), "value", ["report"])


def read_typecheck_outputs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return typecheck_findings(_read_reports(spark, paths), "value", ["report"])


def read_unused_code_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return unused_code_findings(_read_reports(spark, paths), "value", ["report"])
