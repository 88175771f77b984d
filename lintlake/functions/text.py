"""Text functions over code and completions: ``Column -> Column``, JVM-side.

Java flags used below: ``m`` line anchors, ``d`` only ``\\n`` ends a line,
``U`` Unicode classes, ``s`` dot matches newlines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a dynamic language sees it: the Unicode property plus the four
# information separators, which the property leaves out.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

# Patterns whose matches are part of the result: fixed values.
LIBRARY = r"(?mdU)^\s*(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import\s+)"
CODE_FENCE = r"(?s)```python\n(.*?)```"
MODULE_MENTION = r"(?U)\b(\w+)\s+module\b"
TITLE = r"(?s)\*\*Secure Implementation Title:?\*\*:?(.*?)\n"
STATEMENT = r"(?s)\*\*Secure Implementation Statement:?\*\*:?(.*?)\n+"
CODE_STATEMENT = r"(?s)\*\*Secure Code Implementation Statement:?\*\*:?(.*)\n*"
QUALITY_ISSUE = r"(?d)\[({levels})\] Line (\d+(?:-\d+)?): (.+)"
PLACEHOLDER_IMPORT = r"(?md)^from your_module(.*?)\s*$"
PLACEHOLDER_IMPORT_NAMES = r"(?md)^from your_module import .*"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, newlines included. The pattern looks at both ends only."""
    return F.regexp_extract(c, rf"(?sU)\A{SPACE}*+(.*{NON_SPACE})?", 1)


def split_lines(c: Column) -> Column:
    """Lines by every Unicode line break; a final break adds no empty line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def extract_libraries(code: Column) -> Column:
    """Imported module names in document order, duplicates kept."""
    matches = F.regexp_extract_all(code, F.lit(LIBRARY), F.lit(0))
    names = F.transform(
        matches, lambda m: F.concat(F.regexp_extract(m, LIBRARY, 1), F.regexp_extract(m, LIBRARY, 2))
    )
    return F.filter(names, lambda n: n != "")


def extract_code_block(text: Column) -> Column:
    """Body of the first fenced Python block; null when absent or empty."""
    return F.nullif(F.regexp_extract(text, CODE_FENCE, 1), F.lit(""))


def extract_module_names(text: Column) -> Column:
    """Every word that is followed by the word ``module``."""
    return F.regexp_extract_all(text, F.lit(MODULE_MENTION), F.lit(1))


def _titled(text: Column, pattern: str) -> Column:
    body = F.replace(strip(F.regexp_extract(text, pattern, 1)), F.lit("\n"), F.lit(""))
    return F.when(text.rlike(pattern), body)


def implementation_title(text: Column) -> Column:
    return _titled(text, TITLE)


def implementation_statement(text: Column) -> Column:
    return _titled(text, STATEMENT)


def code_statement(text: Column) -> Column:
    return _titled(text, CODE_STATEMENT)


def quality_issues(text: Column, include_critical: bool = False) -> Column:
    """``[PRIORITY] Line n: action`` entries as structs, entries about loggers left out."""
    levels = "LOW|MEDIUM|HIGH|CRITICAL" if include_critical else "LOW|MEDIUM|HIGH"
    pattern = QUALITY_ISSUE.format(levels=levels)
    entries = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("priority"),
            F.regexp_extract(m, pattern, 2).alias("lines"),
            F.regexp_extract(m, pattern, 3).alias("action"),
        ),
    )
    return F.filter(entries, lambda e: ~F.contains(e["action"], F.lit("logger")))


def quality_summary(text: Column, include_critical: bool = False) -> Column:
    """The quality entries of one response as newline-joined text."""
    return F.array_join(
        F.transform(
            quality_issues(text, include_critical),
            lambda e: F.concat(F.lit("priority: "), e["priority"], F.lit(", corrective action: "), e["action"]),
        ),
        "\n",
    )


def strip_placeholder_imports(code: Column, names_only: bool = False) -> Column:
    """Blank out imports of the ``your_module`` placeholder a completion may contain."""
    return F.regexp_replace(code, PLACEHOLDER_IMPORT_NAMES if names_only else PLACEHOLDER_IMPORT, "")


def prepend_if_absent(text: Column, header: Column) -> Column:
    return F.when(F.contains(text, header), text).otherwise(F.concat(header, text))


def test_outcome(stdout: Column, stderr: Column) -> Column:
    """True when neither stream of a test run speaks of a failure or an error."""
    out, err = F.upper(stdout), F.upper(stderr)
    return ~(
        F.contains(out, F.lit("FAIL")) | F.contains(out, F.lit("ERROR")) | F.contains(err, F.lit("ERROR"))
    )


# -- paths -------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension with its dot; leading dots belong to the stem."""
    return F.regexp_extract(base_name(path), r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)


def stem(path: Column) -> Column:
    base = base_name(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


def folder(path: Column) -> Column:
    """Everything before the last slash, empty when there is none."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def module_import(path: Column) -> Column:
    """``from a.b`` for ``a/b.py``: every occurrence of the extension goes, slashes become dots."""
    ext = extension(path)
    bare = F.when(ext == "", path).otherwise(F.replace(path, ext, F.lit("")))
    dotted = F.replace(bare, F.lit("/"), F.lit("."))
    return F.when(F.contains(dotted, F.lit(".")), F.concat(F.lit("from "), dotted)).otherwise(
        F.concat(F.lit("from ."), dotted)
    )


def report_path(path: Column, tool: str = "bandit") -> Column:
    """Report file name of one scanned file, its folder flattened into the name."""
    return F.concat(
        F.lit(f"{tool}_"), F.replace(folder(path), F.lit("/"), F.lit("_")), F.lit("_"), stem(path), F.lit(".json")
    )


def attempt_path(base: Column, section: Column, iteration: Column, ext: Column) -> Column:
    return F.concat(base, F.lit("_iteration_"), section, F.lit("_"), iteration.cast("string"), ext)


def signature(name: Column, args: Column, returns: Column) -> Column:
    """``def n(a: T, b: Any) -> R`` from ``args ARRAY<STRUCT<name, type>>``."""
    rendered = F.array_join(
        F.transform(args, lambda a: F.concat(a["name"], F.lit(": "), F.coalesce(a["type"], F.lit("Any")))), ", "
    )
    return F.concat(
        F.lit("def "), name, F.lit("("), rendered, F.lit(") -> "), F.coalesce(returns, F.lit("Any"))
    )
