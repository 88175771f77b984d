"""Which line of one version of a text became which line of another, for all texts at once.

Lines that occur once in both versions are anchors: they are the same line wherever they stand, so a block
that moved past another one is recognised. Any other line is looked for at the place that the nearest anchor
above, or else below, predicts, and is the same line if its text is.

Lines are shuffled once, by ``keys``: those of a text then lie together, and every further step sorts them within
its task. The few keys that own a large part of all lines go another way, on which every step is a join or an
aggregate on ``keys`` and a line (its text or its number); there a window sees one block of ``BLOCK`` lines, and
what a block has to know from its neighbours is one anchor on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.session import shuffled

BLOCK = 1024  # lines that a window sorts
LARGE = 65_536  # lines of both versions that a key may have beside the other lines of its task
SLOTS = 65_536  # hashes of keys whose lines are counted together


def lines_of(texts: DataFrame, keys: Sequence[str], text: str = "code") -> DataFrame:
    """``keys, line, content``: the lines of each text, counted from 1; a null text has none."""
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("at", "content"))
    return rows.select(*keys, (F.col("at") + 1).cast("long").alias("line"), "content")


def anchors(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, line, to``: lines whose content occurs once in either version (blank lines never do)."""

    def single(lines: DataFrame, name: str) -> DataFrame:
        rows = lines.where(F.trim("content") != "").groupBy(*keys, "content").agg(F.min("line").alias(name), F.count(F.lit(1)).alias("_n"))
        return rows.where("_n = 1").drop("_n")

    return single(before, "line").join(shuffled(single(after, "to")), [*keys, "content"]).select(*keys, "line", "to")


def _nearest(lines: DataFrame, anchored: DataFrame, keys: Sequence[str], above: bool) -> DataFrame:
    """``keys, line, content, shift``: the shift of the nearest anchor at or above (below) each line, null without one."""
    sign = 1 if above else -1
    place = lambda df: df.withColumn("_o", F.col("line") * sign)
    block = F.floor(F.col("_o") / BLOCK)
    rows = place(lines).select(*keys, "line", "content", "_o", F.lit(None).cast("long").alias("_shift"), F.lit(1).alias("_side"))
    marks = place(anchored).select(*keys, "line", F.lit(None).cast("string").alias("content"), "_o", (F.col("to") - F.col("line")).alias("_shift"), F.lit(0).alias("_side"))
    both = rows.unionByName(marks).withColumn("_block", block)
    # the last anchor of each block, and of the blocks before it
    ends = both.groupBy(*keys, "_block").agg(F.max_by("_shift", F.when(F.col("_side") == 0, F.col("_o"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_block", F.last("_end", True).over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_near", F.last("_shift", True).over(inside)).where("_side = 1")
    return found.join(shuffled(ends), [*keys, "_block"]).select(*keys, "line", "content", F.coalesce("_near", "_before").alias("shift"))


def _slots_of_large(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> Column:
    """The slots (hashes of ``keys``) with far more lines than others: more than ``LARGE``, and than four times the mean.

    A slot is counted, not a key, so each task sends ``SLOTS`` numbers at most. There are fewer than ``SLOTS / 4``
    such slots, and a key that is in none has less than ``4 / SLOTS`` of all lines, or no more than ``LARGE``.
    """
    lines = before.select(*keys).unionByName(after.select(*keys))
    counts = lines.groupBy(_slot(keys).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.collect_list(F.struct("slot", "n")).alias("every"), F.sum("n").alias("total"))
    large = f"filter(every, x -> x.n > greatest({LARGE}L, total * 4 div {SLOTS}))"
    return every.select(F.expr(f"transform({large}, x -> x.slot)")).scalar()


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def _moved_together(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`moved_lines` of keys whose lines fit a task: one shuffle by ``keys``, then sorts within it."""
    sides = [df.select(*keys, "line", "content", F.lit(i).alias("_side")) for i, df in enumerate((before, after))]
    rows = sides[0].unionByName(sides[1]).repartition(*keys)
    old, new = F.col("_side") == 0, F.col("_side") == 1
    # only what both versions hold can be the same line
    same = Window.partitionBy(*keys, "content")
    rows = rows.withColumns({"_old": F.count_if(old).over(same), "_new": F.count_if(new).over(same), "_to": F.max(F.when(new, F.col("line"))).over(same)})
    rows = rows.where("_old > 0 AND _new > 0").withColumn("_anchor", F.expr("_old = 1 AND _new = 1 AND trim(content) != ''"))
    # a number of either version that an anchor has is settled
    taken = F.bool_or("_anchor").over(Window.partitionBy(*keys, "_side", "line"))
    rows = rows.withColumn("_taken", taken).where((F.col("_anchor") & old) | ~F.col("_taken"))
    rows = rows.select(*keys, "_side", "line", "content", "_anchor", F.when(F.col("_anchor"), F.col("_to") - F.col("line")).alias("_shift"))
    text = Window.partitionBy(*keys, "_side")
    for name, order in (("_above", F.col("line").asc()), ("_below", F.col("line").desc())):
        near = text.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(name, F.last("_shift", True).over(near))
    # the lines that each one aims at, better guess first; a free line of the other version aims at itself
    aim = lambda rank, shift: F.struct(F.lit(rank).alias("_rank"), (F.col("line") + shift).alias("to"))
    aims = F.when(F.col("_anchor"), F.array(aim(0, F.col("_shift")))).when(new, F.array(aim(0, F.lit(0))))
    aims = aims.otherwise(F.array(aim(0, F.col("_above")), aim(1, F.col("_below"))))
    rows = rows.select(*keys, "_side", "line", "content", "_anchor", F.inline(aims)).where("to IS NOT NULL")
    free = F.bool_or(new).over(Window.partitionBy(*keys, "to", "content"))
    rows = rows.withColumn("_free", free).where(old & (F.col("_anchor") | F.col("_free")))
    # each line takes its better guess, and each line of the other version the better of those that aim at it; anchors stay
    by_rank = lambda name: [F.min(F.when(F.col("_rank") == r, F.col(name))).alias(f"_{r}") for r in (0, 1)]
    best = rows.groupBy(*keys, "line", F.when(F.col("_anchor"), F.col("content")).alias("_own")).agg(*by_rank("to"))
    best = best.select(*keys, "line", F.coalesce("_0", "_1").alias("to"), F.when(F.col("_0").isNull(), 1).otherwise(0).alias("_rank"), "_own")
    won = best.groupBy(*keys, "to", "_own").agg(*by_rank("line"))
    return won.select(*keys, F.coalesce("_0", "_1").alias("line"), "to")


def _moved_apart(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`moved_lines` of keys of any size: no step needs all lines of a key in one task."""
    anchored = anchors(before, after, keys)
    rest = before.join(shuffled(anchored.select(*keys, "line")), [*keys, "line"], "left_anti")
    taken = anchored.select(*keys, F.col("to").alias("line"))
    free = after.join(shuffled(taken), [*keys, "line"], "left_anti").select(*keys, F.col("line").alias("to"), "content")

    def predicted(above: bool, rank: int) -> DataFrame:
        near = _nearest(rest, anchored, keys, above).where("shift IS NOT NULL")
        aimed = near.select(*keys, "line", "content", (F.col("line") + F.col("shift")).alias("to"))
        return aimed.join(shuffled(free), [*keys, "to", "content"]).select(*keys, "line", "to", F.lit(rank).alias("_rank"))

    guesses = predicted(True, 0).unionByName(predicted(False, 1))
    # each line takes its better guess, and each line of the other version the better of those that aim at it
    best = guesses.groupBy(*keys, "line").agg(F.min(F.struct("_rank", "to")).alias("_g")).select(*keys, "line", "_g._rank", "_g.to")
    won = best.groupBy(*keys, "to").agg(F.min(F.struct("_rank", "line")).alias("_g")).select(*keys, F.col("_g.line").alias("line"), "to")
    return anchored.unionByName(won)


def moved_lines(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, line, to``: lines of ``before`` (``keys, line, content``) and the line of ``after`` that each became.

    A line of either side is in one row at most. Lines without an equal at the place an anchor predicts, and texts
    without any anchor, are in none. Keys that are null meet nothing. The rows are dealt by ``keys``.
    """
    before, after = (df.dropna(subset=[*keys, "content"]) for df in (before, after))
    large = F.array_contains(_slots_of_large(before, after, keys), _slot(keys))
    together = _moved_together(before.where(~large), after.where(~large), keys)
    return together.unionByName(_moved_apart(before.where(large), after.where(large), keys).repartition(*keys))


def compare_moved(
    before: DataFrame,
    after: DataFrame,
    lines: DataFrame,
    keys: Sequence[str] = ("path", "section"),
    identity: Sequence[str] = ("tool", "rule_id"),
) -> DataFrame:
    """``keys, identity, line, to, status`` of findings of two versions (``keys, identity, line``).

    ``lines`` comes from :func:`moved_lines`. A finding is ``kept`` when the other version has one of the same
    identity on the line that its line became (``line`` and ``to`` tell where it was and is), else ``fixed`` or
    ``new``. Equal findings on one line count once.
    """
    # lines and findings of a key lie together, so that ``lines``, dealt by key, are not shuffled again
    found = before.select(*keys, *identity, "line", F.lit(None).cast("long").alias("_to"), F.lit(1).alias("_side")).repartition(*keys)
    blank = [F.col(c) if c in keys else F.lit(None).cast(before.schema[c].dataType).alias(c) for c in (*keys, *identity)]
    became = lines.dropna(subset=[*keys, "line"]).select(*blank, "line", F.col("to").alias("_to"), F.lit(0).alias("_side"))
    places = F.collect_set("_to").over(Window.partitionBy(*keys, "line"))
    old = became.unionByName(found).withColumn("_places", places).where("_side = 1")
    old = old.select(*keys, *identity, "line", F.explode_outer("_places").alias("to"))
    new = after.select(*keys, *identity, F.col("line").alias("to")).repartition(*keys)
    # findings whose line is gone cannot meet one: they have a number of their own instead
    sides = [
        old.select(*keys, *identity, F.coalesce("to", -F.col("line")).alias("_at"), "line", F.lit(None).cast("long").alias("to")),
        new.select(*keys, *identity, F.col("to").alias("_at"), F.lit(None).cast("long").alias("line"), F.col("to").cast("long").alias("to")),
    ]
    met = sides[0].unionByName(sides[1]).groupBy(*keys, *identity, "_at").agg(F.max("line").alias("line"), F.max("to").alias("to"))
    status: Column = F.when(F.col("to").isNull(), F.lit("fixed")).when(F.col("line").isNull(), F.lit("new")).otherwise(F.lit("kept"))
    return met.select(*keys, *identity, "line", "to", status.alias("status"))
