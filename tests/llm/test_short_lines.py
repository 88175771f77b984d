"""Near lines of any length from 7 characters on against brute force."""

import random

import pytest

from lintlake.llm import line_dedup
from lintlake.llm.common import written

from .test_repeats import roots_of


def shingles(line):
    return frozenset(line[i : i + 7] for i in range(len(line) - 6)) or frozenset([line])


def table():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n)).replace(" ", "k", 1)
    lines = ["Copyright 2021 Foo Ltd", "Copyright 2021 Foo Ltd.", "All rights reserved 2020", "All rights reserved 2021"]
    lines += ["short", "shorts", "short", "1234567", "12345678", "abcdabcdabcd", "abcdabcdabcda", "ünï😀cödé 😀 line", "ünï😀cödé 😀 line."]
    lines += ["-" * n for n in range(5, 45)] + ["ab " * n for n in range(2, 40, 3)] + ["abcdefghijklmnopqrstuvw" * n for n in (1, 2, 3)]
    for n in range(7, 26):
        for _ in range(6):
            base = word(n)
            lines += [base, base + word(1), word(2) + base, base[1:], base[:-1] + "z", base + word(4)]
    lines += [f"Copyright {year} {word(3)} Ltd" for year in range(1900, 2100)]
    rng.shuffle(lines)
    return [(k, "\n".join(lines[k::20]), "a") for k in range(20)]


def passages():
    """Lines with a long passage in common, most of them far from each other, some near; and families of near lines."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = []
    for _ in range(3):
        common = " ".join(word(6) for _ in range(12))
        for k in range(60):
            own = " ".join(word(6) for _ in range(9))
            lines += [f"{own} {common}"] + [f"{own} {common} {word(3)}"] * (k % 7 == 0) + [f"{word(4)}{own[4:]} {common}"] * (k % 11 == 0)
        family = " ".join(word(6) for _ in range(8))
        lines += [f"{family} {common} {word(4 + k % 9)}" for k in range(40)]
    rng.shuffle(lines)
    return [(k, "\n".join(lines[k::20]), "a") for k in range(20)]


def check(make, rows, least):
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.duplicate_lines(make(rows)).collect()}
    lines = [(doc, k, line) for doc, text, _ in rows for k, line in enumerate(text.split("\n")) if line.strip()]
    names = sorted({line for *_, line in lines})
    sets = [shingles(n) for n in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots, at = roots_of(range(len(names)), links), {n: k for k, n in enumerate(names)}
    seen, gone = set(), {doc: [] for doc, *_ in rows}
    for doc, k, line in lines:
        if roots[at[line]] in seen:
            gone[doc].append(k)
        seen.add(roots[at[line]])
    assert len(links) > least
    assert got == gone


def test_short_lines(make):
    check(make, table(), 300)


@pytest.mark.parametrize("small", [4, 24, 128])
def test_lines_with_a_common_passage(make, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "PIVOTS", max(small, 16))
    rounds = []
    monkeypatch.setattr(line_dedup, "written", lambda df, name="step": rounds.append(name) or written(df, name))
    check(make, passages(), 300)
    assert rounds.count("stars") <= 20  # not one for each line of a group


def test_lines_of_characters_beyond_the_first_plane(make):
    """A character of two UTF-16 units is one character of a shingle, wherever it stands."""
    rng = random.Random(5)
    faces = [chr(0x1F600 + k) for k in range(60)]
    lines = []
    for _ in range(6):
        base = rng.sample(faces, 50)
        lines += ["".join(base), "".join(base[:45]), "".join([*base, *rng.sample(faces, 3)]), "ab".join(base[:14]), "ab".join(base[:13]) + "ab"]
        lines += ["".join(base[:k]) for k in range(11, 50)]
    rng.shuffle(lines)
    check(make, [(k, "\n".join(lines[k::20]), "a") for k in range(20)], 100)


def cloud():
    """Lines around each of a few lines, most near it, some only near others."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = []
    for _ in range(2):
        base = [word(6) for _ in range(40)]
        for k in range(260):
            own = list(base)
            for at in rng.sample(range(40), rng.choice([1, 2, 3, 4, 5])):
                own[at] = word(5)
            lines.append(" ".join(own))
    rng.shuffle(lines)
    return [(k, "\n".join(lines[k::20]), "a") for k in range(20)]


def test_lines_around_others(make, monkeypatch):
    """Few of the pairs of a large group are compared by text, and none that links connect already."""
    monkeypatch.setattr(line_dedup, "SMALL", 16)
    compared = []
    jaccard = line_dedup.jaccard
    monkeypatch.setattr(line_dedup, "jaccard", lambda pairs, texts: jaccard(compared.append(pairs.count()) or pairs, texts))
    rows = cloud()
    check(make, rows, 1000)
    assert sum(compared) < 520 * 16, compared


def test_small_groups_compare_what_links_do_not_connect(make, monkeypatch):
    """Of small groups, too, only pairs that no links connect yet and whose sketches are close are compared by text."""
    compared = []
    jaccard = line_dedup.jaccard
    monkeypatch.setattr(line_dedup, "jaccard", lambda pairs, texts: jaccard(compared.append(pairs.count()) or pairs, texts))
    monkeypatch.setattr(line_dedup, "SMALL", 1 << 20)
    check(make, cloud(), 1000)
    stars, *others = compared
    assert sum(others) < stars / 4, compared


def test_texts_are_packed(make, monkeypatch):
    """The tables that hold whole lines are written by zstd, the largest part of op1's disk."""
    held = {}
    packed = line_dedup.packed
    monkeypatch.setattr(line_dedup, "packed", lambda df, name: held.setdefault(name, packed(df, name)))
    check(make, passages(), 300)
    assert sorted(held) == ["lines", "texts"]
    assert all(".zstd." in f for df in held.values() for f in df.inputFiles())


def test_long_lines_of_few_shingles(make):
    """They are told from lines that only begin so, wherever the other shingles stand."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = []
    for n in (3, 5, 7, 11):
        unit = word(n)
        lines += [unit * k for k in (9, 40, 400)] + [unit * k + word(9) for k in (9, 40, 400)] + [unit * 40 + word(60)]
    lines += [word(23) * 20 for _ in range(3)] + [word(24) * 20 for _ in range(3)]
    rng.shuffle(lines)
    check(make, [(k, "\n".join(lines[k::10]), "a") for k in range(10)], 10)
