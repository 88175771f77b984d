"""Files that cannot be taken apart give an error row and never fail a job."""

import pytest

from lintlake.operators.code_facts import file_facts


@pytest.mark.parametrize("text", [None, "x = " + "+".join(["1"] * 1500), "def f(:", "(" * 500, "\0"])
def test_broken_files(text):
    rows = file_facts("a.py", text)
    assert len(rows) == 1 and rows[0]["kind"] == "error" or not any(r["kind"] == "error" for r in rows)


def test_null_text():
    assert [r["kind"] for r in file_facts("a.py", None)] == ["error"]
