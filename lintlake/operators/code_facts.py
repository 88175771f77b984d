"""Source text to symbol tables. Parsing needs Python, so it is one Arrow-batched pass that emits rows; everything
after it is relational."""

from __future__ import annotations

import ast
import io
import itertools
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import schemas
from lintlake.functions.text import SPACE, split_lines, strip
from lintlake.operators.symbols import MAIN_SCOPE, is_constant
from lintlake.session import shuffled

BATCH_FACTS = 20_000
_ARROW_TYPES = {"STRING": pa.string(), "INT": pa.int32()}
_ARGS = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
FACT_ARROW = pa.schema([(name, _ARROW_TYPES.get(kind, _ARGS)) for name, kind in schemas.SYMBOL_FACT_TYPES.items()])
CLEAN_ARROW = pa.schema([("path", pa.string()), ("code", pa.string()), ("error", pa.string())])


# Nodes that can hold definitions or imports; expressions cannot.
_HOLDERS = (ast.stmt, ast.excepthandler, ast.match_case)


# -- per-file helpers (run inside tasks) -------------------------------------------


def _scopes(tree: ast.Module) -> Iterator[tuple[ast.AST, str]]:
    """Statements breadth first with the dotted scope that holds them; function bodies are marked ``<locals>``."""
    level = [(tree, "")]
    while level:
        below = []
        for node, scope in level:
            yield node, scope
            inner = scope
            if isinstance(node, ast.FunctionDef):
                inner = f"{scope}{node.name}.<locals>."
            elif isinstance(node, (ast.ClassDef, ast.AsyncFunctionDef)):
                inner = f"{scope}{node.name}."
            elif not isinstance(node, ast.Module) and scope == "" and isinstance(node, ast.stmt):
                inner = "<block>."
            below.extend((c, inner) for c in ast.iter_child_nodes(node) if isinstance(c, _HOLDERS))
        level = below


def _call(value: ast.expr) -> tuple[str | None, str | None]:
    """Class and single bare-name argument of ``Class(argument)``."""
    if not (isinstance(value, ast.Call) and isinstance(value.func, ast.Name)):
        return None, None
    single = len(value.args) == 1 and isinstance(value.args[0], ast.Name)
    return value.func.id, value.args[0].id if single else None


def _line_starts(source: bytes) -> list[int]:
    """Byte offset at which each line starts; the parser's columns are bytes."""
    return [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", source))]


def file_facts(path: str, text: str | None) -> list[dict]:
    """Fact rows of one file; a file that cannot be taken apart (it is null, does not parse, or nests
    too deeply to be written out again) gives one ``error`` row and nothing else."""
    try:
        return list(_facts(path, text))
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as problem:
        return [{"path": path, "kind": "error", "code": f"{type(problem).__name__}: {problem}"}]


def _facts(path: str, text: str) -> Iterator[dict]:
    tree = ast.parse(text)
    source = text.encode()
    starts = _line_starts(source)

    def segment(node: ast.AST) -> str:
        begin, end = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
        return source[begin:end].decode()

    def row(kind: str, node: ast.AST, pos: int, scope: str = "", **fields) -> dict:
        base = {"path": path, "kind": kind, "scope": scope, "pos": pos, "line": node.lineno, "end_line": node.end_lineno}
        return {**base, **fields}

    def uses(node: ast.AST, pos: int, scope: str) -> Iterator[dict]:
        names = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}
        yield from (row("ref", node, pos, scope, name=n) for n in sorted(names))

    opened = False  # whether code that stays in place has been seen
    for pos, (node, scope) in enumerate(_scopes(tree)):
        top, unparsed = scope == "", None
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            module = (node.module or "") if isinstance(node, ast.ImportFrom) else None
            for at, alias in enumerate(node.names):
                yield row("import", node, pos, scope, alias_pos=at, module=module, name=alias.name,
                          alias=alias.asname, code=segment(node), unparsed=ast.unparse(node))
            continue
        if isinstance(node, ast.FunctionDef):
            args = [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in node.args.args]
            unparsed = ast.unparse(node)
            yield row("def", node, pos, scope, name=node.name, args=args, code=segment(node), unparsed=unparsed,
                      returns=ast.unparse(node.returns) if node.returns else None)
            if top:
                yield from uses(node, pos, node.name)
        if not top or not isinstance(node, ast.stmt):
            continue
        if isinstance(node, ast.Assign):
            call_class, call_arg = _call(node.value)
            for target in (t.id for t in node.targets if isinstance(t, ast.Name)):
                yield row("assign", node, pos, name=target, call_class=call_class, call_arg=call_arg,
                          code=segment(node), unparsed=ast.unparse(node))
                opened = opened or not (target.isupper() or call_arg)
            continue
        if isinstance(node, ast.If) and "__main__" in segment(node):
            yield row("main", node, pos, MAIN_SCOPE, code=segment(node))
            yield from uses(node, pos, MAIN_SCOPE)
        # a string that opens the remaining code is written as its docstring
        whole = node if opened else ast.Module(body=[node], type_ignores=[])
        yield row("statement", node, pos, unparsed=unparsed or ast.unparse(whole), name=type(node).__name__)
        opened = True


def code_without_comments(source: str) -> str:
    """The source with comment and docstring spans cut out; what stays keeps its column.

    A string counts as a docstring when it directly follows an indent or opens
    the file. Line continuations are joined.
    """
    starts = [0]
    for text_line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(text_line))
    tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
    dropped = []
    for token, before in zip(tokens, [tokenize.INDENT, *(t.type for t in tokens)]):
        if token.type == tokenize.COMMENT or (token.type == tokenize.STRING and before == tokenize.INDENT):
            dropped.append((starts[token.start[0] - 1] + token.start[1], starts[token.end[0] - 1] + token.end[1]))
    for left, right in zip(tokens, tokens[1:]):
        if right.start[0] > left.end[0] and left.type not in (tokenize.NEWLINE, tokenize.NL, tokenize.DEDENT):
            dropped.append((starts[left.end[0] - 1] + left.end[1], starts[right.start[0] - 1]))
    kept, at = [], 0
    for begin, end in sorted(dropped):
        kept.append(source[at:begin])
        at = max(at, end)
    return "".join([*kept, source[at:]])


# -- jobs --------------------------------------------------------------------------


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text")):
            yield path.as_py(), text.as_py()


def symbol_facts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One pass over ``path, text`` giving every fact kind: ``def, import, assign, ref, main, statement, error``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (fact for file_path, source in _sources(batches) for fact in file_facts(file_path, source))
        while chunk := list(itertools.islice(rows, BATCH_FACTS)):
            yield pa.RecordBatch.from_pylist(chunk, FACT_ARROW)

    sources = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    return sources.mapInArrow(emit, schemas.SYMBOL_FACTS)


def strip_comments(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, code, error``: one row per file; ``error`` says why a file could not be read."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_path, source in _sources(iter([batch])):
                try:
                    rows.append({"path": file_path, "code": code_without_comments(source)})
                except (tokenize.TokenError, SyntaxError) as problem:
                    rows.append({"path": file_path, "error": f"{type(problem).__name__}: {problem}"})
            yield pa.RecordBatch.from_pylist(rows, CLEAN_ARROW)

    sources = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    return sources.mapInArrow(clean, "path string, code string, error string")


# -- views of the facts --------------------------------------------------------------


def functions(facts: DataFrame) -> DataFrame:
    """Every plain ``def`` at any depth in breadth-first order: ``path, pos, name, scope, args, returns, ...``."""
    return facts.filter(F.col("kind") == "def").select(
        "path", "pos", "name", "scope", "line", "end_line", "args", "returns", "code", "unparsed"
    )


def methods(facts: DataFrame) -> DataFrame:
    """Top-level functions."""
    return functions(facts).filter(F.col("scope") == "")


def module_functions(facts: DataFrame) -> DataFrame:
    """Functions outside of other functions, class methods included, in document order."""
    outer = functions(facts).filter(~F.contains("scope", F.lit("<locals>")))
    return outer.select("path", F.col("line").alias("pos"), "name", F.col("unparsed").alias("code"))


def imports(facts: DataFrame) -> DataFrame:
    """Top-level imports, one row per alias."""
    return all_imports(facts).filter(F.col("scope") == "").drop("scope")


def all_imports(facts: DataFrame) -> DataFrame:
    rows = facts.filter(F.col("kind") == "import")
    return rows.select(
        "path", "scope", "pos", "alias_pos", "module", "name", "alias", "code", "unparsed"
    )


def module_imports(facts: DataFrame) -> DataFrame:
    """Import statements outside of functions, normalised."""
    outer = all_imports(facts).filter(~F.contains("scope", F.lit("<locals>")))
    return outer.select("path", F.col("unparsed").alias("code")).distinct()


def assigns(facts: DataFrame) -> DataFrame:
    """Top-level assignments, one row per bare-name target."""
    rows = facts.filter(F.col("kind") == "assign")
    return rows.select("path", "pos", "name", "call_class", "call_arg", "code", "unparsed")


def refs(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "ref").select("path", "scope", "name")


def main_blocks(facts: DataFrame) -> DataFrame:
    """The last main block of each file."""
    rows = facts.filter(F.col("kind") == "main")
    return rows.groupBy("path").agg(F.max_by("code", "pos").alias("code"))


def errors(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "error").select("path", F.col("code").alias("error"))


def other_statements(facts: DataFrame) -> DataFrame:
    """``path, pos, code``: top-level code that is neither import, constant nor instance.

    An assignment counts once per target that is neither; a function or class
    after other code is set off by an empty line.
    """
    assigned = assigns(facts).filter(
        ~is_constant(F.col("name")) & (F.col("call_class").isNull() | F.col("call_arg").isNull())
    )
    plain = facts.filter(F.col("kind") == "statement")
    rows = assigned.select("path", "pos", "unparsed", F.lit(False).alias("block")).unionByName(
        plain.select("path", "pos", "unparsed", F.col("name").isin("FunctionDef", "AsyncFunctionDef", "ClassDef").alias("block"))
    )
    first = rows.groupBy("path").agg(F.min("pos").alias("_first"))
    set_off = F.col("block") & (F.col("pos") > F.col("_first"))
    return rows.join(shuffled(first), "path").select(
        "path", "pos", F.concat(F.when(set_off, F.lit("\n")).otherwise(F.lit("")), "unparsed").alias("code")
    )


def leading_blocks(text: Column) -> Column:
    """``ARRAY<STRUCT<line, name, block>>``: comment and decorator lines right above each top-level ``def``.

    A fold over the lines of one text (every Unicode line break ends one); the block restarts after every
    other line. Lines lose the white space around them. Texts without ``@`` and ``#`` are not folded.
    """
    none = F.array().cast("array<struct<line: int, name: string, block: string>>")
    start = F.struct(
        F.lit(0).alias("line"),
        F.array().cast("array<string>").alias("block"),
        none.alias("found"),
    )

    def step(state: Column, line: Column) -> Column:
        marked = line.rlike(rf"(?U)\A{SPACE}*[@#]")
        name = F.regexp_extract(line, r"(?U)\Adef\s+(\w+)", 1)
        number = state["line"] + 1
        block = F.array_join(state["block"], "\n")
        hit = F.struct(number.alias("line"), name.alias("name"), block.alias("block"))
        return F.struct(
            number.alias("line"),
            F.when(marked, F.array_append(state["block"], strip(line)))
            .otherwise(F.array().cast("array<string>"))
            .alias("block"),
            F.when((name != "") & (F.size(state["block"]) > 0), F.array_append(state["found"], hit))
            .otherwise(state["found"])
            .alias("found"),
        )

    folded = F.aggregate(split_lines(text), start, step, lambda s: s["found"])
    return F.when(F.contains(text, F.lit("def")) & text.rlike("[@#]"), folded).otherwise(none)


def leading_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, line, name, block``."""
    found = files.select(*keys, leading_blocks(F.col(text)).alias("found"))
    rows = found.select(*keys, F.explode_outer("found").alias("f")).filter(F.col("f").isNotNull())
    return rows.select(*keys, "f.*")
