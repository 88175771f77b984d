"""Relations between symbols of a file: which function uses what, what is unused, merged imports and modules.

Inputs are fact tables (see ``code_facts``): ``assigns(keys, pos, name, code, ...)``,
``refs(keys, scope, name)``, ``imports(keys, pos, alias_pos, module, name, code)`` and
``methods(keys, pos, name, code)``. Everything joins on ``keys + name``, so one
large file spreads over many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.paging import dense_text_pages, sorted_positions, sorted_text_pages, text_pages
from lintlake.session import shuffled

KEYS = ("path",)
MAIN_SCOPE = "__main__"

# The documented modules of 3.10 count as standard, whichever interpreter runs.
# Modules that came later, and those that later releases dropped: fixed values.
LATER_MODULES = ("annotationlib", "compression", "tomllib")
DROPPED_MODULES = (
    "aifc", "asynchat", "asyncore", "audioop", "binhex", "cgi", "cgitb", "chunk", "crypt", "distutils",
    "imghdr", "imp", "lib2to3", "mailcap", "msilib", "nis", "nntplib", "ossaudiodev", "pipes", "smtpd",
    "sndhdr", "spwd", "sunau", "telnetlib", "uu", "xdrlib",
)
STANDARD_MODULES = tuple(
    sorted(
        {m for m in sys.stdlib_module_names if not m.startswith("_")} - set(LATER_MODULES)
        | {"__future__", "__main__", "_thread", *DROPPED_MODULES}
    )
)

# Test kinds of the generated tests: fixed values.
TEST_TYPES = (
    ("positive", "**Positive Test:** Verifies normal method behavior."),
    ("negative", "**Negative Test:** Handles invalid input."),
    ("boundary", "**Boundary Test:** Tests a special edge value."),
)


# -- dictionaries: last value wins, first position stays ----------------------


def last_definition(rows: DataFrame, keys: Sequence[str] = KEYS, value: Sequence[str] = ("code",)) -> DataFrame:
    """``keys, name, pos, value...``: the last row per name at the position of the first."""
    return (
        rows.groupBy(*keys, "name")
        .agg(F.max_by(F.struct(*value), F.col("pos")).alias("_last"), F.min("pos").alias("pos"))
        .select(*keys, "name", "pos", "_last.*")
    )


def method_table(methods: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return last_definition(methods, keys)


def global_table(assigns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return last_definition(assigns, keys)


def without_main(methods: DataFrame, name: str = "name") -> DataFrame:
    """Functions called ``main`` are neither imported nor tested."""
    return methods.filter(F.col(name) != "main")


def is_constant(name: Column) -> Column:
    """At least one cased character, and none in lower case."""
    return (F.upper(name) == name) & (F.lower(name) != name)


def assignment_kind(name: Column, call_class: Column, call_arg: Column) -> Column:
    """``constant``, ``instance`` (one call with one bare name), or ``other``."""
    return (
        F.when(is_constant(name), F.lit("constant"))
        .when(call_class.isNotNull() & call_arg.isNotNull(), F.lit("instance"))
        .otherwise(F.lit("other"))
    )


def is_main_block(kind: Column, code: Column) -> Column:
    """An ``if`` statement that mentions the main guard."""
    return (kind == "if") & F.contains(code, F.lit("__main__"))


def method_counts(methods: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return methods.groupBy(*keys).agg(F.count_distinct("name").alias("methods"))


# -- uses ----------------------------------------------------------------------


def global_uses(assigns: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, scope, name, pos, code``: globals that occur as a bare name in a scope."""
    used = refs.select(*keys, "scope", "name").distinct()
    return used.join(shuffled(global_table(assigns, keys)), [*keys, "name"])


def import_uses(imports: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per import alias whose original name occurs as a bare name in a scope."""
    used = refs.select(*keys, "scope", "name").distinct()
    aliases = imports.select(*keys, "pos", "alias_pos", "name", "code")
    return used.join(shuffled(aliases), [*keys, "name"])


def function_uses(refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct names that functions use; what only the main block uses is left out."""
    return refs.filter(F.col("scope") != MAIN_SCOPE).select(*keys, "name").distinct()


def used_globals(assigns: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names that count as used: those functions use, and instances the main block uses."""
    return function_uses(refs, keys).unionByName(instance_uses(assigns, refs, keys).select(*keys, "name"))


def unused_globals(assigns: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Globals that neither a function nor, as an instance, the main block uses."""
    return global_table(assigns, keys).join(shuffled(used_globals(assigns, refs, keys)), [*keys, "name"], "left_anti")


def unused_imports(imports: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Import statements none of whose aliases a function uses, compared by statement text."""
    used = function_uses(refs, keys)
    used_code = imports.join(shuffled(used), [*keys, "name"], "left_semi").select(*keys, "code").distinct()
    statements = imports.select(*keys, "pos", "code").distinct()
    return statements.join(shuffled(used_code), [*keys, "code"], "left_anti")


def instance_uses(assigns: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, name, pos, code, call_class``: instances that the main block uses.

    A name is an instance once any of its assignments calls a class; ``pos`` is the first such
    assignment, ``call_class`` the last class called, ``code`` the last assignment of the name.
    """
    called = F.when(F.col("call_class").isNotNull(), F.col("pos"))
    instances = (
        assigns.groupBy(*keys, "name")
        .agg(F.min(called).alias("pos"), F.max_by("code", "pos").alias("code"), F.max_by("call_class", called).alias("call_class"))
        .filter(F.col("pos").isNotNull())
    )
    used = refs.filter(F.col("scope") == MAIN_SCOPE).select(*keys, "name").distinct()
    return instances.join(shuffled(used), [*keys, "name"], "left_semi")


def method_imports(methods: DataFrame, statements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each method with the import statement a test needs for it."""
    lookup = statements.groupBy(*keys, "name").agg(F.max("import_statement").alias("import_statement"))
    return methods.join(shuffled(lookup), [*keys, "name"])


def test_plan(
    methods: DataFrame, keys: Sequence[str] = KEYS, types: Sequence[tuple[str, str]] = TEST_TYPES
) -> DataFrame:
    """Every method but ``main`` with every test type: an explode of literals, not a cross join."""
    kinds = F.array(*[F.struct(F.lit(t).alias("test_type"), F.lit(d).alias("description")) for t, d in types])
    return without_main(methods).select(*keys, "name", "code", F.inline(kinds))


def with_leading_lines(methods: DataFrame, leading: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each function's code below the comment and decorator lines that stand right above it.

    ``leading`` has ``keys, line, block``; joined per definition, before a later
    definition of the same name replaces an earlier one.
    """
    blocks = leading.select(*keys, "line", "block")
    return methods.join(shuffled(blocks), [*keys, "line"], "left").withColumn("code", F.concat_ws("\n", "block", "code")).drop("block")


def method_slices(
    methods: DataFrame,
    assigns: DataFrame,
    imports: DataFrame,
    refs: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``keys, name, page, code``: each function with what it uses put on top.

    Each later match goes above the earlier ones: imports in reverse order, then
    globals in reverse order, then the code (see :func:`with_leading_lines` for
    its comments and decorators).
    """
    own = [*keys, "scope"]

    def pieces(df: DataFrame, part: int, alias_pos: Column, *columns: str | Column) -> DataFrame:
        return df.select(
            *keys,
            *columns,
            F.lit(part).alias("part"),
            (-F.col("pos")).cast("bigint").alias("up"),
            (-alias_pos).cast("bigint").alias("alias_up"),
            F.col("code").alias("piece"),
        )

    # imports and globals are both looked up by name, so one join serves them
    table = method_table(methods, keys)
    named = pieces(imports, 0, F.col("alias_pos"), "name").unionByName(
        pieces(global_table(assigns, keys), 1, F.lit(0), "name")
    )
    wanted = table.select(*keys, F.col("name").alias("scope"))
    used = refs.select(*keys, "scope", "name").distinct().join(shuffled(wanted), own, "left_semi")
    context = used.join(shuffled(named), [*keys, "name"]).drop("name")
    rows = context.unionByName(pieces(table, 2, F.lit(0), F.col("name").alias("scope")))
    pages = sorted_text_pages(rows, own, ["part", "up", "alias_up"], "piece", "\n", "code")
    return pages.withColumnRenamed("scope", "name")


MAIN_CODE = 1 << 40  # the place of a main block below everything it is put together with


def script_parts(
    files: DataFrame, assigns: DataFrame, imports: DataFrame, refs: DataFrame, mains: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, part, page, text``: what a script has beside its functions, for each of ``files`` (``keys``).

    * ``import_statements``: those none of whose names a function uses, as often as they occur;
    * ``global_variables``: the last assignment of each name that nothing uses, at the place of the first;
    * ``main_script``: the last main block, below the instances it uses, later ones above earlier ones.

    ``mains`` has ``keys, pos, code``, ``refs`` also ``pos``: of several main blocks all count as uses, only the last
    one is kept. A part without lines is one empty page.
    """
    def lines(df: DataFrame, part: str, at: Column) -> DataFrame:
        return df.select(*keys, F.lit(part).alias("part"), at.cast("bigint").alias("at"), F.col("code").alias("piece"))

    last = mains.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max_by("code", "pos").alias("code"))
    inside = refs.filter(F.col("scope") == MAIN_SCOPE).join(shuffled(last.select(*keys, "pos")), [*keys, "pos"], "left_semi")
    rows = (
        lines(unused_imports(imports, refs, keys), "import_statements", F.col("pos"))
        .unionByName(lines(unused_globals(assigns, refs, keys), "global_variables", F.col("pos")))
        .unionByName(lines(instance_uses(assigns, inside, keys), "main_script", -F.col("pos")))
        .unionByName(lines(last, "main_script", F.lit(MAIN_CODE)))
    )
    pages = text_pages(rows, [*keys, "part"], "at", "piece", "\n", "text", then=["piece"])
    parts = F.array(*[F.lit(p) for p in ("import_statements", "global_variables", "main_script")])
    every = files.select(*keys, F.explode(parts).alias("part"))
    return every.join(shuffled(pages), [*keys, "part"], "left").select(
        *keys, "part", F.coalesce("page", F.lit(0)).cast("bigint").alias("page"), F.coalesce("text", F.lit("")).alias("text")
    )


# -- imports ---------------------------------------------------------------------


def merged_imports(imports: DataFrame, keys: Sequence[str] = KEYS, keep_alias: bool = False) -> DataFrame:
    """``keys, module, page, statement``: distinct names per module in name order, plain imports apart.

    Aliases are dropped unless ``keep_alias``.
    """
    name = F.col("name")
    if keep_alias:
        name = F.when(F.col("alias").isNotNull(), F.concat("name", F.lit(" as "), "alias")).otherwise(name)
    # distinct() aggregates before the shuffle: a hot module arrives as its names
    names = imports.select(*keys, "module", name.alias("name")).distinct()
    plain = names.filter(F.col("module").isNull()).select(
        *keys, "module", F.lit(0).cast("bigint").alias("page"), F.concat(F.lit("import "), "name").alias("statement")
    )
    members = names.filter(F.col("module").isNotNull())
    merged = sorted_text_pages(members, [*keys, "module"], ["name"], "name", ", ", "names")
    return plain.unionByName(
        merged.select(
            *keys, "module", "page", F.concat(F.lit("from "), "module", F.lit(" import "), "names").alias("statement")
        )
    )


def import_group(
    statement: Column, standard: Sequence[str] = STANDARD_MODULES, exact: bool = False
) -> Column:
    """``standard``, ``local`` or ``third_party``.

    The default is a prefix test without a word boundary (``requests`` counts as
    standard because of ``re``); ``exact`` compares the whole top-level name.
    """
    names = "|".join(m.replace(".", r"\.") for m in standard)
    end = r"(?![\w])" if exact else ""
    return (
        F.when(statement.rlike(rf"\A(?:import|from) (?:{names}){end}"), F.lit("standard"))
        .when(statement.rlike(r"\A(?:from|import) \."), F.lit("local"))
        .otherwise(F.lit("third_party"))
    )


def grouped_imports(merged: DataFrame, keys: Sequence[str] = KEYS, exact: bool = False) -> DataFrame:
    """``keys, import_group, page, statements``: each group's statements sorted, newline-joined."""
    rows = merged.select(*keys, import_group(F.col("statement"), exact=exact).alias("import_group"), "statement")
    return sorted_text_pages(rows, [*keys, "import_group"], ["statement"], "statement", "\n", "statements")


def import_map(imports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, module, page, names``: names by statement and alias, duplicates kept; a plain import has none.

    ``imports`` are those of every depth (``code_facts.all_imports``).
    """
    members = imports.filter(F.col("module").isNotNull())
    named = text_pages(members, [*keys, "module"], "pos", "name", ", ", "names", then=["alias_pos"])
    plain = imports.filter(F.col("module").isNull()).select(*keys, F.col("name").alias("module")).distinct()
    only_plain = plain.join(shuffled(members.select(*keys, "module").distinct()), [*keys, "module"], "left_anti")
    return named.unionByName(
        only_plain.select(*keys, "module", F.lit(0).cast("bigint").alias("page"), F.lit("").alias("names"))
    )


# -- whole modules -----------------------------------------------------------------


def combined_functions(functions: DataFrame, keys: Sequence[str] = ("project",), file_pos: str = "file_id") -> DataFrame:
    """``keys, name, code, first_file, first_pos``.

    Inside a file the first definition counts, across files the last file does,
    and a name keeps the place where it was first seen. Both rules are one
    aggregate over (file, -pos), so a name defined everywhere is reduced map-side.
    """
    place = F.struct(F.col(file_pos).alias("file"), F.col("pos").alias("pos"))
    newest = F.struct(F.col(file_pos).alias("file"), (-F.col("pos")).alias("up"))
    return (
        functions.groupBy(*keys, "name")
        .agg(F.max_by("code", newest).alias("code"), F.min(place).alias("_first"))
        .select(
            *keys, "name", "code", F.col("_first.file").alias("first_file"), F.col("_first.pos").alias("first_pos")
        )
    )


def combined_imports(imports: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Distinct import statements of all files."""
    return imports.select(*keys, F.col("code").alias("statement")).distinct()


def main_block(functions: DataFrame, keys: Sequence[str] = ("project",), order: Sequence[str] = ("first_file", "first_pos")) -> DataFrame:
    """``keys, page, code``: the guard followed by one indented call per function."""
    ranked = sorted_positions(functions.select(*keys, *order, "name"), keys, order, "_rank")
    calls = ranked.withColumn(
        "call",
        F.concat(
            F.when(F.col("_rank") == 0, F.lit('if __name__ == "__main__":\n    ')).otherwise(F.lit("\n    ")),
            "name",
            F.lit("()"),
        ),
    )
    return dense_text_pages(calls, keys, "_rank", "call", "", "code")


def combined_module(functions: DataFrame, imports: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """``keys, page, code``: one module per key from ``combined_functions`` and ``combined_imports``."""

    def pieces(df: DataFrame, part: int, statement: Column, text: Column, *place: Column) -> DataFrame:
        first_file, first_pos = place or (F.lit(0), F.lit(0))
        return df.select(
            *keys,
            F.lit(part).alias("part"),
            statement.alias("statement"),
            first_file.cast("bigint").alias("first_file"),
            first_pos.cast("bigint").alias("first_pos"),
            text.alias("piece"),
        )

    none, spot = F.lit(""), (F.col("first_file"), F.col("first_pos"))
    guard = 'if __name__ == "__main__":'
    # one row per key: what surrounds the statements, the functions and the calls
    present = (
        imports.select(*keys, F.lit(1).alias("i"), F.lit(0).alias("f"))
        .unionByName(functions.select(*keys, F.lit(0).alias("i"), F.lit(1).alias("f")))
        .groupBy(*keys)
        .agg(F.max("i").alias("i"), F.max("f").alias("f"))
    )
    after_imports = F.when(F.col("i") == 1, F.lit("\n")).otherwise(F.lit("\n\n"))
    before_calls = F.when(F.col("f") == 1, F.lit(guard)).otherwise(F.lit(guard + "\n    "))
    rows = (
        pieces(imports, 0, F.col("statement"), F.concat("statement", F.lit("\n")))
        .unionByName(pieces(present, 1, none, after_imports))
        .unionByName(pieces(functions, 2, none, F.concat("code", F.lit("\n\n")), *spot))
        .unionByName(pieces(present, 3, none, before_calls))
        .unionByName(pieces(functions, 4, none, F.concat(F.lit("\n    "), "name", F.lit("()")), *spot))
    )
    return sorted_text_pages(rows, keys, ["part", "statement", "first_file", "first_pos"], "piece", "", "code")


def organised_module(
    merged: DataFrame, assigns: DataFrame, statements: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, page, code``: imports by group, constants, instances, remaining statements.

    ``merged`` comes from :func:`merged_imports`; ``statements`` has ``keys, pos, code``.
    The module is a list of lines, an empty part being one empty line.
    """
    group_part = {"standard": 0, "third_party": 2, "local": 4}
    kind_part = {"constant": 7, "instance": 9}

    def part_of(c: Column, parts: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(c == name, F.lit(n)) for name, n in parts.items()])

    import_lines = merged.select(
        *keys,
        part_of(import_group(F.col("statement")), group_part).alias("part"),
        F.col("statement").alias("sorted_by"),
        F.lit(0).cast("bigint").alias("pos"),
        F.col("statement").alias("piece"),
    )
    kind = assignment_kind(F.col("name"), F.col("call_class"), F.col("call_arg"))
    # constants are a dictionary (last wins); instances are distinct statements
    constants = last_definition(assigns.filter(is_constant(F.col("name"))), keys)
    instances = (
        assigns.filter(kind == "instance")
        .groupBy(*keys, "name", "call_class", "call_arg", "code")
        .agg(F.min("pos").alias("pos"))
    )

    def lines(df: DataFrame, part: int) -> DataFrame:
        return df.select(
            *keys,
            F.lit(part).alias("part"),
            F.lit("").alias("sorted_by"),
            F.col("pos").cast("bigint").alias("pos"),
            F.col("code").alias("piece"),
        )

    body = (
        import_lines.unionByName(lines(constants, kind_part["constant"]))
        .unionByName(lines(instances, kind_part["instance"]))
        .unionByName(lines(statements, 11))
    )
    has = {p: F.max((F.col("part") == p).cast("int")) for p in (0, 2, 4, 7, 9, 11)}
    present = body.groupBy(*keys).agg(*[c.alias(f"p{p}") for p, c in has.items()])
    std, third, local = (F.col(f"p{p}") == 1 for p in (0, 2, 4))
    blanks = F.filter(
        F.array(
            F.when(std & (third | local), F.lit(1)),
            F.when(local & (std | third), F.lit(3)),
            F.when(~(std | third | local), F.lit(5)),
            F.lit(6),
            F.when(F.col("p7") == 0, F.lit(7)),
            F.lit(8),
            F.when(F.col("p9") == 0, F.lit(9)),
            F.lit(10),
            F.when(F.col("p11") == 0, F.lit(11)),
        ),
        lambda p: p.isNotNull(),
    )
    frame = present.select(*keys, F.explode(blanks).alias("part")).select(
        *keys,
        "part",
        F.lit("").alias("sorted_by"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit("").alias("piece"),
    )
    return sorted_text_pages(body.unionByName(frame), keys, ["part", "sorted_by", "pos"], "piece", "\n", "code")
