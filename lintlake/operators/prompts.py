"""Prompt rows for a repair model: templates, findings, budgets."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import budget
from lintlake.functions import text as tx
from lintlake.operators.rules import substitution_instruction


def render_template(template: str, holes: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` holes. Text that comes out of a hole is never filled again."""
    pieces: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(holes[name].cast("string"), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def messages(system: Column, user: Column) -> Column:
    """A two-message chat: ``ARRAY<STRUCT<role, content>>``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def attempt_findings(attempts: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempt *i* with the issue pages of attempt *i*; clean attempts get one empty page."""
    on = [*keys, "iteration"]
    return attempts.join(issues.select(*on, "page", "issues"), on, "left").withColumns(
        {"page": F.coalesce("page", F.lit(0)).cast("bigint"), "issues": F.coalesce("issues", F.lit(""))}
    )


def user_prompt(
    template: str, issues: Column, code: Column, lines: Column, words: Column, guidance: Mapping[str, str]
) -> Column:
    """Findings, the filled template, then the code."""
    filled = render_template(
        template,
        {
            "substitution_code_instruction": substitution_instruction(code, guidance),
            "word_count": words,
            "line_count": lines,
        },
    )
    return F.concat(tx.strip(F.concat(issues, F.lit("\n\n"), filled)), F.lit("\n\n"), code)


def with_sizes(originals: DataFrame) -> DataFrame:
    """``originals`` with ``_lines`` and ``_words``, which set the size limits of their prompts."""
    return originals.withColumns({"_lines": budget.line_count(F.col("code")), "_words": budget.word_count(F.col("code"))})


def prompt_rows(
    attempts: DataFrame,
    issues: DataFrame,
    originals: DataFrame | None,
    template: str,
    system: str,
    guidance: Mapping[str, str],
    allowance: int,
    keys: Sequence[str] = ("path", "section"),
) -> DataFrame:
    """``keys, iteration, page, temperature, messages``.

    ``attempts`` has ``keys, iteration, code``; ``originals`` has ``keys, code``
    and sets the size limits; without ``originals`` the attempts carry theirs (:func:`with_sizes`).
    An attempt with a null key is not prompted. Findings beyond one page give further prompts with
    the same code, so none is lost.
    """
    if originals is not None:
        sized = with_sizes(originals.select(*keys, "code")).select(*keys, "_lines", "_words")
        attempts = attempts.join(sized, list(keys))
    else:
        attempts = attempts.dropna(subset=list(keys))
    rows = attempt_findings(attempts, issues, keys).filter(F.col("iteration") < allowance)
    n, i = F.lit(allowance), F.col("iteration")
    prompt = user_prompt(
        template,
        F.col("issues"),
        F.col("code"),
        budget.line_budget(F.col("_lines"), n, i),
        budget.word_budget(F.col("_words"), n, i),
        guidance,
    )
    return rows.select(
        *keys,
        "iteration",
        "page",
        budget.temperature(n, i).alias("temperature"),
        messages(F.lit(system), prompt).alias("messages"),
    )


def test_prompt_rows(plan: DataFrame, template: str, system: str) -> DataFrame:
    """A test prompt per planned test; ``plan`` comes from ``symbols.test_plan``."""
    prompt = render_template(template, {"method_code": F.col("code"), "description": F.col("description")})
    return plan.withColumn("messages", messages(F.lit(system), prompt)).drop("code")
