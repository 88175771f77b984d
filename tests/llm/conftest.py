import pytest

SCHEMA = "doc_id long, text string, source string, n_chars int, did string, cls int"


@pytest.fixture(scope="session")
def shared(spark):
    return spark


@pytest.fixture(scope="session")
def make(shared):
    """Documents with clashing extra columns from (doc_id, text, source) rows."""

    def build(rows):
        return shared.createDataFrame([(i, t, s, None if t is None else len(t), "x", 1) for i, t, s in rows], SCHEMA)

    return build


def prose(seed, words, vocabulary=400):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, ties, a null id."""
    base, passage = prose(1, 300), prose(2, 60)
    words = base.split(" ")
    near = " ".join(["new", *words[1:]])
    lines = "\n".join(prose(k, 12) for k in range(20, 26))
    return [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, prose(3, 40) + " " + passage, "b"),
        (5, passage + "\n" + prose(4, 90), None), (6, "", "a"), (7, None, "c"), (8, " \n\t ", "c"),
        (9, "one two", "a"), (10, "one two", "a"), (11, prose(5, 30_000, 5000), "a"), (12, lines, "b"),
        (13, lines.replace("\n", "\n\n", 1), "b"), (14, "ab " * 400, "a"), (15, "ünïcode 😀 " * 30 + passage, "c"),
        (16, lines + " end", None), (None, passage, "a"), (17, "x" * 50_000, "b"),
    ]
