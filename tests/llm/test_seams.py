"""Texts longer than what is hashed at once: every window is looked at once, whatever the cut."""

import random

import numpy as np
import pytest

from lintlake.llm import repeats, suffix_index

from .conftest import prose
from .test_repeats import test_bytes as bytes_by_brute_force
from .test_repeats import test_words as words_by_brute_force


@pytest.fixture(scope="module")
def longer(rows):
    """The shared rows, of which the longest are shorter here, and texts of many chunks."""
    passage = prose(41, 70)
    return [r for r in rows if r[0] not in (11, 17)] + [
        (50, prose(42, 900, 5000), "a"),
        (51, f"{prose(43, 333, 5000)} {passage} {prose(44, 500, 5000)}", "a"),
        (52, f"{prose(45, 120, 5000)} {passage}", "b"),
        (53, "x" * 3000, "b"),
    ]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_words_in_chunks(make, longer, monkeypatch, hot):
    monkeypatch.setattr(repeats, "_CHUNK", 64)
    words_by_brute_force(make, longer, monkeypatch, hot)


@pytest.mark.parametrize("batches, hot", [(1, 20_000), (2, 1)])
def test_bytes_in_chunks(make, longer, monkeypatch, batches, hot):
    monkeypatch.setattr(repeats, "_CHUNK", 512)
    bytes_by_brute_force(make, longer, monkeypatch, batches, hot)


@pytest.mark.parametrize("n", [20, 63, 64, 65, 109, 110, 111, 1000])
def test_pieces_hold_each_window_once(n):
    how = repeats.Windows(words=True, width=20, k=6, chunk=64)
    starts = [at + k for _, shift, lo, hi, _ in repeats._pieces(np.zeros(n), np.array([0, n]), how) for at in [shift] for k in range(hi - lo - 19)]
    assert starts == list(range(n - 19))


def test_a_long_text_without_repeats_stays_whole(make):
    """Two seams of the real chunk size."""
    text = random.Random(7).randbytes(1_100_000).hex()
    (row,) = suffix_index.remove_repeats(make([(1, text, "a")])).collect()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (2_200_000, 0, 0)
