"""Fuzzy line dedup by MinHash; DataFrame functions only.

1. Every distinct line (named by its 64-bit hash) is cut into character shingles. Half of them,
   chosen by their hash and so the same in every line, picks one of 5 x 8 bins and a value each; the
   least value of a bin, or of the next bin of the eight that has one, is the line's signature.
2. Ten bands of four bins give buckets (a pair of similarity 0.8 shares one with 99.5 %). Lines of few
   distinct shingles have buckets without any chance: near lines share one of their rarest shingles.
   A bucket is named after its least line, its pivot, and a line meets each of its pivots once.
3. Lines are verified exactly against their pivot. 1 - Jaccard is a metric, so a line farther than
   0.4 from the pivot cannot be near one that is within 0.2 of it: what is left over in a group are
   the lines that failed and, if one of them is close enough, the lines it might be near. Large
   left-overs get another pivot as long as it settles a quarter of the open lines, as in families of
   copies. Of what is left then and of small left-overs, only pairs that the distances to the pivot
   allow, that no links connect yet and whose sketches are close are compared.
4. Union-find over the verified links; the first line (doc_id, then line number) of each component
   stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import column, packed, unused, written
from lintlake.llm.components import components

SHINGLE = 7
THRESHOLD = 0.8
APART = 1 - THRESHOLD + 1e-9  # near lines have similarities to any third that differ by no more
LEAST = 20  # shingles from which on bands find a line's near ones; below, the rarest shingles do
FEW = 23  # the most distinct shingles of a line that may be near one of fewer than LEAST
GROUPS, BINS, ROWS = 5, 8, 4  # groups of bins, bins of a group, bins of a band
SAMPLE = 2  # one shingle in so many enters the signature
BORROW = (1, 2, 4)  # doubling steps by which an empty bin takes the value of the next one of its group
SMALL = 128  # lines of a left-over group that gets no further pivot
PIVOTS = 2048  # lines of a group that one task compares by sketch with all of the group
SKETCH = 16  # words of 64 bits in a sketch of a line's shingles
SETTLED = 0.75  # where no more of a group's open lines are still open after a pivot, another pivot follows
SIEVE_BITS = 24
NULL_ID = -(1 << 63)


def _shingles(units: str) -> str:
    """SQL for the number of shingles of a UTF-32 string."""
    return f"greatest(octet_length({units}) div 4 - {SHINGLE - 1}, 1)"


def grams(name: str | Column) -> Column:
    """The shingles of a line, none of a line shorter than one. Each match takes one character, so that none begins inside one of two UTF-16 units."""
    return F.regexp_extract_all(name, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))


def lines_of(documents: DataFrame) -> DataFrame:
    """(did, t, line_no, line, cls) of every line that is not blank; blank lines are never dropped."""
    named = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64("text").alias("t"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    )
    return named.where("line rlike '\\\\S'").withColumn("cls", F.xxhash64("line"))


def rarest_of(lines: DataFrame) -> DataFrame:
    """(bucket, cls): the rarest shingles of each line that has at most ``FEW`` distinct ones.

    Near lines have four fifths of either's n shingles in common. In any order of all shingles their
    first common one is therefore among the first n div 5 + 1 of both; rare ones come first, so that
    buckets stay small.
    """
    likely = lines.where(F.length("line") >= SHINGLE)
    for first in (FEW + SHINGLE, 10 * (FEW + SHINGLE)):  # a line has few only if its beginning has, which is cut sooner
        likely = likely.where(F.size(F.array_distinct(grams(F.substring("line", 1, first)))) <= FEW)
    sets = likely.select("cls", F.array_distinct(grams("line")).alias("grams")).where(F.size("grams") <= FEW)
    each = written(sets.select("cls", F.explode("grams").alias("gram")).select("cls", F.xxhash64("gram").alias("h")).distinct(), "few")
    counts = each.groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "h").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("all"))
    first = ranked.select("cls", F.explode(F.expr("slice(all, 1, size(all) div 5 + 1)")).alias("one"))
    return first.select("cls", F.xxhash64(F.lit("rare"), "one.h").alias("bucket"))


def sketches_of(texts: DataFrame) -> DataFrame:
    """(cls, s0, s1, ...) of these lines: one bit of a sketch is turned over for each shingle, so that the
    sketches of two lines differ in no more bits than the lines do in shingles."""
    each = texts.select("cls", F.explode(hashes("line")).alias("h"))
    turned = "bit_xor(if((shiftright(h, 6) & {mask}) = {k}, shiftleft(1L, cast(h & 63 as int)), 0L))"
    return each.groupBy("cls").agg(*[F.expr(turned.format(mask=SKETCH - 1, k=k)).alias(f"s{k}") for k in range(SKETCH)])


def buckets_of(lines: DataFrame) -> DataFrame:
    """(bucket, cls): the bands of each distinct line. The lines are shuffled, which is less than their
    signatures would be; all that follows stays where its line is."""
    once = lines.where(F.length("line") >= LEAST + SHINGLE - 1).select("cls", "line").repartition("cls").distinct()
    units = once.select("cls", F.encode("line", "UTF-32").alias("units"))
    each = units.select("cls", "units", F.explode(F.expr(f"sequence(0, cast({_shingles('units')} - 1 as int))")).alias("i"))
    value = each.select("cls", F.expr(f"xxhash64(substring(units, 4 * i + 1, {4 * SHINGLE}))").alias("h"))
    value = value.where((F.col("h").bitwiseAND(F.lit(SAMPLE - 1))) == 0)
    split = value.selectExpr(
        "cls",
        f"cast((shiftright(h, 1) & 65535) % {GROUPS} as int) AS part",
        f"cast(shiftright(h, 17) & {BINS - 1} as int) AS bin",
        "cast(shiftrightunsigned(h, 33) as int) AS v",
    )
    filled = split.groupBy("cls", "part").agg(*[F.min(F.when(F.col("bin") == b, F.col("v"))).alias(f"m{b}") for b in range(BINS)])
    for step in BORROW:  # each step is a projection of its own, so that its code stays short enough to be compiled
        filled = filled.select("cls", "part", *[F.coalesce(f"m{k}", f"m{(k + step) % BINS}").alias(f"m{k}") for k in range(BINS)])
    stride = BINS // ROWS
    bands = [F.xxhash64("part", F.lit(b), *[f"m{k}" for k in range(b, BINS, stride)]) for b in range(stride)]
    return filled.select("cls", F.explode(F.array(*bands)).alias("bucket"))


def members_of(buckets: DataFrame) -> DataFrame:
    """(gid, cls): lines by pivot, groups of one left out. One shuffle by bucket serves both sides."""
    dealt = buckets.repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.min("cls").alias("gid"), F.max("cls").alias("most")).where("gid <> most")
    return dealt.join(shared.hint("shuffle_hash"), "bucket").select("gid", "cls").distinct()


def texts_of(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, line) of the members. A bit map of fixed size (2 MB) keeps other lines out of the shuffle."""
    wanted = members.select("cls").distinct()
    bit = f"(pmod(cls, {1 << SIEVE_BITS}) + 1)"
    maps = (
        wanted.selectExpr(f"bitmap_bucket_number({bit}) AS bucket", f"bitmap_bit_position({bit}) AS pos")
        .groupBy("bucket")
        .agg(F.expr("bitmap_construct_agg(pos)").alias("map"))
    )
    seen = lines.selectExpr("cls", "line", f"bitmap_bucket_number({bit}) AS bucket", f"bitmap_bit_position({bit}) AS pos")
    byte = "cast(conv(hex(substring(map, cast(pos div 8 + 1 as int), 1)), 16, 10) as int)"
    likely = seen.join(F.broadcast(maps), "bucket").where(f"(shiftright({byte}, cast(pos % 8 as int)) & 1) = 1")
    return likely.groupBy("cls").agg(F.min("line").alias("line")).join(wanted, "cls", "left_semi")


def hashes(line: str) -> Column:
    """The distinct shingles of a line, each named by its 64-bit hash."""
    return F.array_distinct(F.transform(grams(line), lambda gram: F.xxhash64(gram)))


def jaccard(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``jac``, ``size`` and ``common`` to pairs (a, b): the exact similarity of the lines' shingle
    sets, the number of shingles of b and how many of them a has too. The shingles are cut after the
    shuffles, which move the lines only."""
    left = texts.select(F.col("cls").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("cls").alias("b"), F.col("line").alias("lb"))
    both = pairs.join(right, "b").join(left, "a").withColumns({"ga": hashes("la"), "gb": hashes("lb")})
    sets = both.select(*pairs.columns, F.size("ga").alias("its"), F.size("gb").alias("size"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    return sets.withColumn("jac", F.expr("common / (its + size - common)")).drop("its")


def left_over(stars: DataFrame) -> DataFrame:
    """(gid, cls, open, jac, size, common, peel) still to be compared after these stars, where ``jac``
    and ``common`` refer to the group's pivot. ``peel`` says that it settled a good share of the group's
    open lines, so that another pivot will do so too.

    Open lines that failed stay open; lines near the pivot, and those settled before, stay as
    partners if some open line is near enough to the pivot to be near them.
    """
    failed = (F.col("jac") < THRESHOLD) & F.col("open")
    far = F.when(failed, F.col("jac"))
    facts = stars.groupBy("gid").agg(
        F.count(far).alias("n"), F.max(far).alias("closest"), F.min(far).alias("farthest"),
        (F.count(far) <= SETTLED * F.count_if("open")).alias("peel"),
    ).where("n > 0")
    kept = stars.join(facts, "gid").where(
        failed | ((F.col("jac") <= F.col("closest") + APART) & (F.col("jac") >= F.col("farthest") - APART))
    )
    rows = kept.select("gid", F.col("b").alias("cls"), failed.alias("open"), "jac", "size", "common", "peel")
    alone = rows.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select("gid")
    return rows.join(alone, "gid", "left_semi")


MOST = "(least(common, common_b) + least(size - common, size_b - common_b))"
ABLE = f"a < b AND (open OR open_b) AND abs(jac - jac_b) <= {APART} AND {MOST} >= {THRESHOLD - 1e-9} * (size + size_b - {MOST})"


def close_of(rest: DataFrame, known: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, part, part_b, bits): pairs of lines that share a group, without those that links connect already
    and those that cannot be near. Near lines have at most min(common) shingles of the pivot in common and at
    most min(size - common) others, and the sketches of n and m shingles differ in no more than (n + m) / 9
    bits. A task has ``PIVOTS`` lines of a group on one side."""
    words = [f"s{k}" for k in range(SKETCH)]
    blocks = rest.groupBy("gid").agg(F.expr(f"cast(count(*) div {PIVOTS} + 1 as int)").alias("blocks"))
    lines = rest.join(known.select("cls", *words), "cls").join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(blocks, "gid")
    lines = lines.withColumn("part", F.coalesce("component", "cls")).drop("peel", "component")
    facts = [c for c in lines.columns if c not in ("gid", "cls", "blocks")]
    one = lines.withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)")).withColumnRenamed("cls", "a").drop("blocks")
    other = lines.select("gid", F.col("cls").alias("b"), *[F.col(c).alias(f"{c}_b") for c in facts], F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    bits = " + ".join(f"bit_count({w} ^ {w}_b)" for w in words)
    both = one.join(other, ["gid", "block"]).where(f"{ABLE} AND part <> part_b AND 9 * ({bits}) <= size + size_b")
    return both.selectExpr("a", "b", "part", "part_b", f"{bits} AS bits").distinct()


def stars_of(large: DataFrame) -> DataFrame:
    """(gid, a, b, open): the lines ``b`` of large groups with their next pivot ``a``, the open line
    nearest to the last one: of lines that lie around some line, it is one in the middle."""
    pivots = large.where("open").groupBy("gid").agg(F.max(F.struct("jac", "cls"))["cls"].alias("a"))
    lines = large.join(pivots, "gid").where("cls <> a")
    return lines.select("gid", "a", F.col("cls").alias("b"), "open")


def first_stars(members: DataFrame) -> DataFrame:
    """(gid, a, b, open): the lines ``b`` of groups with their pivots ``a``."""
    return members.where("gid <> cls").select("gid", F.col("gid").alias("a"), F.col("cls").alias("b"), F.lit(True).alias("open"))


def union_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def links_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect what the buckets bring together."""
    near = F.col("jac") >= THRESHOLD
    stars, peeled, apart, done = first_stars(members), False, [], []

    def compare(pairs: DataFrame) -> None:
        done.append(written(jaccard(pairs, texts).where(near), "pairs").select("a", "b"))

    while True:
        stars = written(jaccard(stars, texts), "stars")
        done.append(stars.where(near).select("a", "b"))
        rest = written(left_over(stars), "rest")
        sizes = rest.groupBy("gid").agg(F.count("*").alias("n"))
        large = rest.join(sizes.where(F.col("n") > SMALL).select("gid"), "gid", "left_semi")
        large = written(large if peeled else large.withColumn("peel", F.lit(True)), "large")
        apart.append(rest.join(sizes.where(F.col("n") <= SMALL).select("gid"), "gid", "left_semi"))
        if large.isEmpty():
            break
        peeled = True
        apart.append(large.where("NOT peel"))
        stars = stars_of(large.where("peel"))
    rest = union_of(apart)
    known = written(sketches_of(texts.join(rest.select("cls").distinct(), "cls", "left_semi")), "known")
    close = written(close_of(rest, known, components(union_of(done))), "close")
    nearest = close.groupBy(F.least("part", "part_b"), F.greatest("part", "part_b")).agg(F.min(F.struct("bits", "a", "b")).alias("one"))
    compare(nearest.select("one.a", "one.b"))
    parts = components(union_of(done))
    one, other = [parts.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in ("a", "b")]
    still = close.join(one, "a", "left").join(other, "b", "left").where("coalesce(in_a, a) <> coalesce(in_b, b)")
    compare(still.select("a", "b"))
    return union_of(done)


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(did, t, line_no, component, gone) of every line that is not blank."""
    lines = packed(lines_of(documents), "lines")
    members = written(members_of(buckets_of(lines).unionByName(rarest_of(lines))), "members")
    texts = packed(texts_of(lines, members), "texts")
    parts = components(links_of(members, texts))
    seen = lines.select("did", "t", "line_no", "cls").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    seen = written(seen.select("did", "t", "line_no", F.coalesce("component", "cls").alias("component")), "seen")
    first = seen.groupBy("component").agg(F.min(F.struct("did", "t", "line_no")).alias("first"))
    at = F.struct("did", "t", "line_no")
    return seen.join(first, "component").select("did", "t", "line_no", "component", (at != F.col("first")).alias("gone"))


def duplicate_lines(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, t, n_lines, n_removed, removed_lines (numbers from 0, sorted).

    Lines end at "\\n". Of all lines in a component of near-equal lines (Jaccard of 7-character
    shingles >= 0.8; a line of fewer than 7 characters repeats only its equals) the first stays: least doc_id (null first), then
    a hash of the text for rows of one id, then line number. Blank lines always stay. Null texts have
    no lines, an empty text has one. Equal rows (same id and text) are one document and fare alike.
    Other columns are not read. An empty table gives no rows.
    """
    found = repeated_lines(documents).where("gone").groupBy("did", "t").agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    every = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64("text").alias("t"),
        F.expr("cast(coalesce(octet_length(text) - octet_length(replace(text, '\\n', '')) + 1, 0) as long) AS n_lines"),
    )
    none = F.expr("cast(array() as array<int>)")
    return every.join(found, ["did", "t"], "left").select(
        "doc_id", "t", "n_lines",
        F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", none).alias("removed_lines"),
    )


def without_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated lines cut out of ``text`` (``n_chars``, if there is one,
    follows). A document whose lines that are not blank all repeat others is dropped; all others stay.
    Other columns keep their values, whatever their names."""
    did, t, gone, cut = unused(documents, "did", "t", "gone", "cut")
    found = duplicate_lines(documents).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias(did), F.col("t").alias(t), F.col("removed_lines").alias(gone)).dropDuplicates([did, t])
    same = F.col("doc_id").eqNullSafe(F.col(did)) & (F.xxhash64("text") == F.col(t))
    rows = documents.join(found, same, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(gone, i))
    rows = rows.withColumn(cut, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    rows = rows.where(F.col(gone).isNull() | F.col(cut).rlike(r"\S"))

    def value(name):
        if name == "text":
            return F.col(cut).alias("text")
        if name == "n_chars":
            return F.length(cut).cast(documents.schema[name].dataType).alias(name)
        return column(name)

    return rows.select(*[value(c) for c in documents.columns])
