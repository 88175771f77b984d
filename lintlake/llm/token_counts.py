"""Edit-aware token counts.

Each document keeps a segment tree: leaves are runs of whole pre-tokens (cut where no match of the
splitting pattern can cross), nodes hold sums of characters and tokens. An edit re-encodes the
leaves it touches and their neighbours' border characters only, then updates the sums above them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lintlake.llm import bpe
from lintlake.llm.common import mapped

LEAF_CHARS = 256
EDIT = "array<struct<start:int,stop:int,insert:string>>"


class SegmentTree:
    """Sums of characters and tokens over leaves; a leaf's text is found by walking down."""

    def __init__(self, leaves: list[str], counts: list[int]):
        self.leaves = leaves
        self.width = 1
        while self.width < max(1, len(leaves)):
            self.width *= 2
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, (leaf, count) in enumerate(zip(leaves, counts, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(leaf), count
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where that leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, text: str, count: int) -> None:
        if leaf < len(self.leaves):
            self.leaves[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), count
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def text(self) -> str:
        return "".join(self.leaves)


def build(text: str, count) -> SegmentTree:
    leaves = list(bpe.pieces(text, LEAF_CHARS))
    return SegmentTree(leaves, [count(x) for x in leaves])


def edit(tree: SegmentTree, start: int, stop: int, insert: str, count) -> int:
    """Replace characters ``[start, stop)``; returns how many characters were encoded again.

    A cut between two leaves holds because of the characters on either side of it, so leaves with
    a border character next to the edit are encoded again too. Positions beyond the text mean its end.
    """
    total = tree.chars[1]
    start = min(max(0, start), total)
    stop = min(max(start, stop), total)
    if start == stop and not insert:
        return 0
    if not total:
        first, begin, last, last_begin = 0, 0, 0, 0
    else:
        first, begin = tree.find(max(0, start - 1))
        last, last_begin = tree.find(min(stop, total - 1))
    text = "".join(tree.leaves[first : last + 1])
    text = text[: start - begin] + insert + text[stop - begin :]
    tree.put(first, text, sum(map(count, bpe.pieces(text, LEAF_CHARS))))
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, "", 0)
    return len(text)


def count_edits(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts of every whole text before and after its edits, in one narrow step.

    ``edits`` is an array of (start, stop, insert) in code points, applied one after the other to
    the text as it then is; a null array, a null edit or null parts count as no edit, position 0 or
    no text. Null and empty texts count 0 tokens and may still be edited. Adds n_tokens,
    edited_text, edited_tokens, encoded_again (characters); such columns are replaced. Other columns
    and repeated rows stay.
    """
    made = ("n_tokens", "edited_text", "edited_tokens", "encoded_again")
    keep = [c for c in df.columns if c not in made]
    at, edits_at = keep.index(text), keep.index(edits)

    def run(batches):
        tokenizer = bpe.load(ranks_path, pattern)
        count = lambda piece: len(tokenizer.encode_ordinary(piece)) if piece else 0
        for batch in batches:
            rows = []
            for raw, changes in zip(batch.column(at), batch.column(edits_at), strict=True):
                tree = build(raw.as_py() or "", count)
                before, again = tree.tokens[1], 0
                for change in changes.as_py() or []:
                    if change:
                        again += edit(tree, change["start"] or 0, change["stop"] or 0, change["insert"] or "", count)
                rows.append((before, tree.text(), tree.tokens[1], again))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            added = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*keep, *made])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(made, kinds, strict=True))])
    return mapped(df, keep, run, schema)
