"""Repair a corpus: sections, prompts, attempts, consolidated and combined modules.

The model is outside: ``prompts`` gives its input rows, ``attempts_from`` takes
its responses, and a scanner's reports come back as findings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as tx
from lintlake.operators import attempts as at
from lintlake.operators import code_facts as cf
from lintlake.operators import findings as fi
from lintlake.operators import prompts as pr
from lintlake.operators import symbols as sy
from lintlake.session import shuffled
from lintlake.sources import sinks

SECTION = ("path", "section")


def parsed(files: DataFrame) -> DataFrame:
    """Symbol facts of ``path, text``, parsed once for the many joins that read them: kept by the executors from
    the first use on, and parsed again for the part of one that is lost. ``unpersist`` frees them.

    A repair that runs over days writes them to a table of its own instead and passes that as ``facts``.
    """
    return cf.symbol_facts(files).persist()


def sections(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``path, section, page, code``: every top-level function with what it uses on top."""
    facts = parsed(files) if facts is None else facts
    methods = sy.with_leading_lines(cf.methods(facts), cf.leading_lines(files, ["path"]))
    slices = sy.method_slices(methods, cf.assigns(facts), cf.imports(facts), cf.refs(facts))
    return slices.withColumnRenamed("name", "section")


def script_parts(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``path, part, page, text``: imports and globals that no function uses, and the main script, of each file that parses."""
    facts = parsed(files) if facts is None else facts
    readable = files.select("path").distinct().join(shuffled(cf.errors(facts).select("path")), "path", "left_anti")
    refs = facts.filter(F.col("kind") == "ref").select("path", "scope", "name", "pos")
    mains = facts.filter(F.col("kind") == "main").select("path", "pos", "code")
    return sy.script_parts(readable, cf.assigns(facts), cf.imports(facts), refs, mains)


def prompts(
    attempts: DataFrame,
    originals: DataFrame,
    findings: DataFrame,
    template: str,
    system: str,
    guidance: Mapping[str, str],
    allowance: int,
) -> DataFrame:
    """Prompt rows of attempts ``path, section, iteration, code``.

    ``findings`` has ``path, section, iteration, tool, pos, text``; generated
    tests keep only their type-check findings.
    """
    keys = [*SECTION, "iteration"]
    pages = fi.issue_pages(fi.gate_security_scans(findings), [*keys, "tool"])
    issues = fi.issue_sections(pages, keys)
    return pr.prompt_rows(attempts, issues, originals, template, system, guidance, allowance, SECTION)


def attempts_from(responses: DataFrame, findings: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Attempts from ``path, section, iteration, response`` and the findings about their code.

    ``fixed`` may give ``path, section, iteration, fixed_code`` of an import
    fixer; without it the block itself counts as fixed.
    """
    keys = [*SECTION, "iteration"]
    blocks = responses.select(*keys, tx.extract_code_block(F.col("response")).alias("code_block"))
    clean = fi.verdicts(responses, fi.gate_security_scans(findings), keys)
    rows = blocks.join(clean, keys)
    if fixed is None:
        return rows.withColumn("fixed_code", F.col("code_block"))
    return rows.join(fixed.select(*keys, "fixed_code"), keys, "left")


def consolidated(resolved: DataFrame) -> DataFrame:
    """``path, page, text``: each file's resolved sections in name order."""
    return sinks.consolidate_methods(resolved.withColumnRenamed("section", "name"))


def organised(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``path, page, code``: each file with imports, constants and instances moved to the top."""
    facts = parsed(files) if facts is None else facts
    merged = sy.merged_imports(cf.imports(facts))
    constants = cf.assigns(facts)
    code = F.when(sy.is_constant(F.col("name")), F.col("unparsed")).otherwise(F.col("code"))
    return sy.organised_module(merged, constants.withColumn("code", code), cf.other_statements(facts))


def combined(files: DataFrame) -> DataFrame:
    """``project, page, code``: one module per project from ``project, file_id, path, text``."""
    facts = parsed(files.select("path", "text"))
    place = files.select("path", "project", "file_id")
    functions = sy.combined_functions(cf.module_functions(facts).join(shuffled(place), "path"))
    imports = sy.combined_imports(cf.module_imports(facts).join(shuffled(place), "path"))
    return sy.combined_module(functions, imports)


def resolve(attempts: DataFrame, allowance: int) -> DataFrame:
    return at.resolve(attempts, allowance, SECTION)
