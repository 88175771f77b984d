"""Writers: finding reports, consolidated methods, combined modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions import text as tx
from lintlake.operators.paging import sorted_text_pages, text_pages
from lintlake.sources.trees import read_tree, write_tree


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON reports partitioned by tool and run; the path of a file stays a data column."""
    findings.write.mode(mode).partitionBy("tool", "run").json(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FINDINGS).json(path).select(*schemas.FINDING_FIELDS)


def report_files(files: DataFrame, findings: DataFrame, tool: str) -> DataFrame:
    """``path, text``: the JSON report of one tool for each file, clean files included.

    ``files`` has ``path, metrics`` (a VARIANT, null for none), ``findings`` has ``path, pos`` and the fields of a
    finding. A report is ``{"file", "results", "metrics"}``. Results beyond one page go to further reports of the file, which
    carry their page in the name.
    """
    fields = [c for c in findings.columns if c not in ("path", "pos")]
    rows = findings.select("path", "pos", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))
    pages = text_pages(rows, ["path"], "pos", "item", ", ", "items")
    every = files.select("path", "metrics").join(pages, "path", "left")
    page = F.coalesce("page", F.lit(0))
    name = tx.report_path(F.col("path"), tool)
    numbered = F.concat(F.regexp_replace(name, r"\.json\z", "."), page.cast("string"), F.lit(".json"))
    body = F.concat(
        F.lit('{"file": '), F.regexp_extract(F.to_json(F.struct("path")), r"(?s)\A\{\"path\":(.*)\}\z", 1),
        F.lit(', "results": ['), F.coalesce("items", F.lit("")),
        F.lit('], "metrics": '), F.coalesce(F.to_json("metrics"), F.lit("{}")), F.lit("}"),
    )
    return every.select(F.when(page == 0, name).otherwise(numbered).alias("path"), body.alias("text"))


def write_reports(files: DataFrame, findings: DataFrame, tool: str, path: str, mode: str = "overwrite") -> None:
    """One report file for each file and page (see :func:`report_files`) below ``path``."""
    write_tree(report_files(files, findings, tool), path, mode)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``report, status, file, results, metrics`` of all reports below ``path``; ``results`` is an array of VARIANT.

    A report that cannot be read or parsed is a row with status ``failed`` and nulls: it is never clean.
    """
    read = read_tree(spark, path, ".json")
    parsed = F.try_parse_json("text")
    results = F.try_variant_get("v", "$.results", "array<variant>")
    return read.select("path", parsed.alias("v")).select(
        tx.base_name(F.col("path")).alias("report"),
        F.when(results.isNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.try_variant_get("v", "$.file", "string").alias("file"),
        results.alias("results"),
        F.try_variant_get("v", "$.metrics", "variant").alias("metrics"),
    )


def consolidate_methods(methods: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``keys, page, text``: method bodies in name order, each followed by a blank line.

    Methods without code are left out here; :func:`missing_methods` lists them.
    """
    bodies = methods.filter(F.col("code").isNotNull()).select(
        *keys, "name", F.concat("code", F.lit("\n\n")).alias("body")
    )
    return sorted_text_pages(bodies, keys, ["name"], "body", sep="")


def missing_methods(methods: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return methods.filter(F.col("code").isNull()).select(*keys, "name")


def write_text_pages(pages: DataFrame, path: str, keys: Sequence[str], text: str = "text") -> None:
    """One folder per key; its files, in name order, hold the pages in order.

    The writer ends every row with a newline, so the newline a page ends with is taken off first.
    """
    ordered = pages.repartitionByRange(*keys, "page").sortWithinPartitions(*keys, "page")
    body = F.regexp_replace(F.col(text), r"\n\z", "").alias("value")
    ordered.select(*keys, body).write.mode("overwrite").partitionBy(*keys).text(path)
