"""Explicit schemas, as DDL, of the reports and tables the library reads (no inference)."""

BANDIT_REPORT = (
    "results ARRAY<STRUCT<test_id: STRING, line_number: INT, line_range: ARRAY<INT>, issue_text: STRING>>"
)
DODGY_REPORT = "file STRING, issues ARRAY<STRUCT<line_number: INT, variable_name: STRING, reason: STRING>>"
UNUSED_CODE = "ARRAY<STRUCT<type: STRING, name: STRING>>"
GUIDANCE_MAP = "MAP<STRING, STRING>"
RESPONSE_CHUNK = "choices ARRAY<STRUCT<delta: STRUCT<content: STRING>>>"

_FINDINGS = {
    "path": "STRING",
    "run": "STRING",
    "tool": "STRING",
    "pos": "BIGINT",
    "rule_id": "STRING",
    "line": "BIGINT",
    "message": "STRING",
    "attrs": "MAP<STRING, STRING>",
}
SYMBOL_FACT_TYPES = {
    "path": "STRING",
    "kind": "STRING",
    "scope": "STRING",
    "name": "STRING",
    "pos": "INT",
    "line": "INT",
    "end_line": "INT",
    "alias_pos": "INT",
    "module": "STRING",
    "alias": "STRING",
    "args": "ARRAY<STRUCT<name: STRING, type: STRING>>",
    "returns": "STRING",
    "call_class": "STRING",
    "call_arg": "STRING",
    "code": "STRING",
    "unparsed": "STRING",
}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


FINDING_FIELDS = list(_FINDINGS)
FINDINGS = _ddl(_FINDINGS)
SYMBOL_FACTS = _ddl(SYMBOL_FACT_TYPES)
