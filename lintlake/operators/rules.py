"""Matching files against rules and configuration. Rules are plain values, so they become literals in the plan:
patterns compile once per task and nothing is joined."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.functions.formats import NO_ISSUES, dodgy

# Base rulesets, and rulesets triggered by an exact library name: fixed values.
BASE_RULESETS = ("p/default", "p/owasp-top-ten", "p/python")
TRIGGERED_RULESETS = (("django", "p/django"), ("flask", "p/flask"))

# Wording of the substitution instruction: fixed values.
SUBSTITUTION_INTRO = (
    "Please modify the code below strictly according to the provided instructions. Address only the "
    "specific issues mentioned in the following substitution statements as they pertain to the code below,"
    " without adding or assuming anything beyond what is explicitly stated:\n"
)


HITS = "array<struct<line_number: int, variable_name: string, reason: string>>"


@dataclass(frozen=True)
class LineRule:
    """A named pattern. ``needle`` is text every match contains: a cheap test before the pattern runs."""

    variable_name: str
    pattern: str
    reason: str
    needle: str = ""

    def hit(self, line: Column) -> Column:
        matched = line.rlike(self.pattern)
        return F.contains(line, F.lit(self.needle)) & matched if self.needle else matched


def _possible(text: Column, rules: Sequence[LineRule]) -> Column | None:
    """Whether a text can match at all, by needles; None when a rule has no needle."""
    if not all(r.needle for r in rules):
        return None
    out = F.lit(False)
    for needle in dict.fromkeys(r.needle for r in rules):
        out = out | F.contains(text, F.lit(needle))
    return out


def line_hits(text: Column, rules: Sequence[LineRule]) -> Column:
    """``ARRAY<STRUCT<line_number, variable_name, reason>>`` of one text, in line and rule order.

    A text is one row, so its hits need neither an explode nor a shuffle.
    """

    def of_line(line: Column, index: Column) -> Column:
        candidates = F.array(
            *[
                F.when(
                    r.hit(line),
                    F.struct(
                        (index + 1).alias("line_number"),
                        F.lit(r.variable_name).alias("variable_name"),
                        F.lit(r.reason).alias("reason"),
                    ),
                )
                for r in rules
            ]
        )
        return F.filter(candidates, lambda c: c.isNotNull())

    hits = F.flatten(F.transform(F.split(text, "\n", -1), of_line))
    possible = _possible(text, rules)
    return hits if possible is None else F.when(possible, hits).otherwise(F.array().cast(HITS))


def scan_lines(files: DataFrame, rules: Sequence[LineRule], keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys, pos, line_number, variable_name, reason``: one row per hit."""
    possible = _possible(F.col(text), rules)
    candidates = files if possible is None else files.filter(possible)
    hits = candidates.select(*keys, line_hits(F.col(text), rules).alias("hits"))
    return (
        hits.select(*keys, F.posexplode_outer("hits").alias("pos", "h"))
        .filter(F.col("h").isNotNull())
        .select(*keys, "pos", "h.*")
    )


def scan_verdicts(files: DataFrame, rules: Sequence[LineRule], keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys, findings, summary, passed`` per file, clean files included. No shuffle."""
    scanned = files.select(*keys, line_hits(F.col(text), rules).alias("hits"))
    lines = F.transform("hits", lambda h: dodgy(h["line_number"], h["variable_name"], h["reason"]))
    return scanned.select(
        *keys,
        F.size("hits").cast("bigint").alias("findings"),
        F.when(F.size("hits") == 0, F.lit(NO_ISSUES)).otherwise(F.array_join(lines, "\n")).alias("summary"),
        (F.size("hits") == 0).alias("passed"),
    )


def _statements(code: Column, guidance: Mapping[str, str]) -> list[Column]:
    """A statement per guidance entry, null where its needle does not occur."""
    return [
        F.when(F.contains(code, F.lit(needle)), F.lit(f"\t* For '{needle}', {advice}"))
        for needle, advice in guidance.items()
    ]


def matched_guidance(code: Column, guidance: Mapping[str, str]) -> Column:
    """Guidance statements whose needle occurs in the code, in map order."""
    return F.filter(F.array(*_statements(code, guidance)), lambda e: e.isNotNull())


def substitution_instruction(code: Column, guidance: Mapping[str, str]) -> Column:
    """The substitution part of a prompt, empty when no needle occurs."""
    if not guidance:
        return F.lit("")
    statements = F.concat_ws("\n", *_statements(code, guidance))
    return F.when(statements == "", F.lit("")).otherwise(F.concat(F.lit(SUBSTITUTION_INTRO), statements, F.lit("\n")))


def rulesets(
    libraries: Column,
    base: Iterable[str] = BASE_RULESETS,
    triggered: Iterable[tuple[str, str]] = TRIGGERED_RULESETS,
) -> Column:
    """Rulesets to run for a file: the base ones and those an imported library triggers."""
    extra = [F.when(F.array_contains(libraries, lib), F.lit(name)) for lib, name in triggered]
    chosen = F.array(*[F.lit(b) for b in base], *extra)
    return F.filter(chosen, lambda r: r.isNotNull())


def file_rulesets(files: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """``keys, pos, ruleset``."""
    libs = tx.extract_libraries(F.col(code))
    return files.select(*keys, F.posexplode(rulesets(libs)).alias("pos", "ruleset"))
