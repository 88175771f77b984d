"""One finding rendered as report text. The wording is compared with the sentinel and shown in prompts: fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ISSUES = "No issues found."
NO_UNUSED_CODE = "No unused code found."


def _text(c: Column, missing: str = "None") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def int_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


def bandit(test_id: Column, line: Column, line_range: Column, issue: Column) -> Column:
    return F.concat(
        F.lit("- Test ID: "), _text(test_id), F.lit(", Line: "), _text(line),
        F.lit(", Line Range: "), F.coalesce(int_list(line_range), F.lit("None")), F.lit(", Issue: "), _text(issue),
    )


def dodgy(line: Column, variable: Column, reason: Column) -> Column:
    return F.concat(
        F.lit("- Line: "), _text(line), F.lit(", Variable: "), _text(variable), F.lit(", Reason: "), _text(reason)
    )


def _tags(c: Column) -> Column:
    return F.when(F.size(F.coalesce(c, F.array())) == 0, F.lit("None")).otherwise(F.array_join(c, ", "))


def semgrep(line: Column, message: Column, owasp: Column, cwe: Column) -> Column:
    return F.concat(
        F.lit("  Line: "), _text(line), F.lit("\n  Message: "), _text(message),
        F.lit("\n  OWASP: "), _tags(owasp), F.lit("\n  CWE: "), _tags(cwe), F.lit("\n"),
    )


def mypy(line: Column, message: Column) -> Column:
    return F.concat(
        F.lit("Line: "), _text(line, "N/A"), F.lit("\n\tMessage: "), _text(message, "N/A"), F.lit("\n")
    )


def vulture(kind: Column, name: Column) -> Column:
    return F.concat(
        F.lit("\t\t\tType: "), _text(kind, "Unknown"), F.lit(" --> Name: "), _text(name, "N/A"), F.lit("\n")
    )


def no_issues(tool: Column) -> Column:
    """The sentinel a clean file gets from one tool."""
    return F.when(tool == "vulture", F.lit(NO_UNUSED_CODE)).otherwise(F.lit(NO_ISSUES))
