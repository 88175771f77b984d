"""Size and temperature schedules, run labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.text import NON_SPACE


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){NON_SPACE}+"))


def line_budget(lines: Column, allowance: Column, iteration: Column) -> Column:
    """Allowed lines at one iteration: a tenth more, plus half of the rest spread over the rounds."""
    return (lines * F.lit(1.1) + lines * F.lit(0.5) / allowance * iteration).cast("bigint")


def word_budget(words: Column, allowance: Column, iteration: Column) -> Column:
    return (words * F.lit(1.2) + words * F.lit(0.5) / allowance * iteration).cast("bigint")


def round_to_cents(x: Column) -> Column:
    """Two places, rounding the exact binary value (0.025 is stored slightly above 2.5 cents and becomes 0.03).

    ``bround`` rounds the shortest decimal form instead. Here the value times 200
    is compared with the midpoint without rounding error, by splitting off the
    low half of the mantissa. Exact for magnitudes a percentage or ratio can have.
    """
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    cents = F.floor(x * F.lit(100.0)).cast("double")
    above = (high * F.lit(200.0) - (cents * F.lit(2.0) + F.lit(1.0))) + low * F.lit(200.0)
    odd = F.pmod(cents, F.lit(2.0)) == 1.0
    up = (above > 0) | ((above == 0) & odd)
    return (cents + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(100.0)


def temperature(allowance: Column, iteration: Column) -> Column:
    """Sampling temperature from 0 towards 2, to two places."""
    return round_to_cents(F.least(F.lit(2.0), F.lit(2.0) / allowance * iteration))


def run_label(n: Column) -> Column:
    """Spreadsheet-style letters: 0 is A, 25 is Z, 26 is AA; exact for every BIGINT >= 0."""
    n = n.cast("bigint")
    letters = []
    shorter = 0  # how many labels are shorter than the one that needs this letter
    for power in range(14):
        digit = F.floor((n - F.lit(shorter)) / F.lit(26**power)) if power == 0 else _div(n - F.lit(shorter), 26**power)
        letter = F.char(F.pmod(digit, F.lit(26)) + 65)
        letters.append(F.when(n >= F.lit(shorter), letter).otherwise(F.lit("")))
        shorter += 26 ** (power + 1)
        if shorter > 2**63 - 1:
            break
    return F.concat(*reversed(letters))


def _div(value: Column, divisor: int) -> Column:
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))
