"""Edit-aware token counts: a segment tree over pieces of each text.

A text is cut into leaves of some hundred characters, at places where the pre-tokeniser
always cuts: a single space between two visible ASCII or Latin characters. So a leaf's
count does not depend on its neighbours as long as the characters around its ends stay,
and a text's count is the sum over leaves. The tree keeps, for each node, the characters
and tokens below it. An edit finds its leaves by descending, re-encodes only them - and
the next leaf, where an edit comes near a cut - and updates the sums above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii
from .common import lean, small_batches, texts
from .tokenizer import _CUT, PieceEncoder, default_path, encoder

#: Characters after which the next cut ends a leaf.
LEAF = 512
#: An edit this near to a cut may undo it: the characters beside the space decide.
NEAR = 2

Edit = tuple[int, int, str]


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + size) if len(text) - at > size else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class CountTree:
    """Characters and tokens of leaves, summed by a complete binary tree."""

    def __init__(self, text: str, enc: PieceEncoder, size: int = LEAF):
        self.enc, self.size = enc, size
        self.leaf = leaves_of(text, size)
        self.encoded = 0
        self._build([self._count(x) for x in self.leaf])

    @classmethod
    def restored(cls, text: str, chars: list[int], tokens: list[int], enc: PieceEncoder, size: int = LEAF) -> CountTree:
        """A tree from kept leaves: nothing is encoded."""
        self = cls.__new__(cls)
        self.enc, self.size, self.encoded = enc, size, 0
        ends = np.cumsum(chars).tolist()
        self.leaf = [text[e - n : e] for e, n in zip(ends, chars, strict=True)]
        self._build(list(tokens))
        return self

    def _count(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return len(self.enc.encode([leaf])[0])

    def _build(self, tokens: list[int]) -> None:
        n = 1
        while n < len(self.leaf):
            n *= 2
        self.n = n
        self.leaf += [""] * (n - len(self.leaf))
        self.chars = np.zeros(2 * n, np.int64)
        self.tokens = np.zeros(2 * n, np.int64)
        self.chars[n:] = [len(x) for x in self.leaf]
        self.tokens[n : n + len(tokens)] = tokens
        for k in range(n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaf)

    def kept(self) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the leaves that hold any."""
        some = [k for k in range(self.n) if self.leaf[k]]
        return [int(self.chars[self.n + k]) for k in some], [int(self.tokens[self.n + k]) for k in some]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a place; the last one for the end."""
        k, start = 1, 0
        while k < self.n:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += int(self.chars[k])
                k += 1
        return k - self.n, start

    def _set(self, i: int, leaf: str, tokens: int) -> None:
        self.leaf[i] = leaf
        k = self.n + i
        dc, dt = len(leaf) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new``."""
        size = int(self.chars[1])
        if not 0 <= start <= end <= size:
            raise ValueError(f"edit {start}:{end} of {size} characters")
        i, first = self._find(max(0, start - NEAR))
        j, last = self._find(min(size, end + NEAR))
        old = "".join(self.leaf[i : j + 1])
        fresh = old[: start - first] + new + old[end - first :]
        # the outer cuts stay; inside, new leaves fill the slots, the last taking what is left
        parts = leaves_of(fresh, self.size)
        slots = j - i + 1
        if len(parts) > slots:
            parts = [*parts[: slots - 1], "".join(parts[slots - 1 :])]
        for k in range(slots):
            p = parts[k] if k < len(parts) else ""
            self._set(i + k, p, self._count(p) if p else 0)
        if max(len(p) for p in parts) > 8 * self.size:  # a leaf that has grown is cut anew; its slots are not enough
            counts = self.kept()[1]
            self.leaf = [x for x in self.leaf if x]
            grown = [k for k, x in enumerate(self.leaf) if len(x) > 8 * self.size]
            for k in reversed(grown):
                split = leaves_of(self.leaf[k], self.size)
                self.leaf[k : k + 1] = split
                counts[k : k + 1] = [self._count(x) for x in split]
            self.leaf = self.leaf or [""]
            self._build(counts or [0])

    def edits(self, edits: list[Edit]) -> None:
        """Apply edits whose places all refer to the text as it is now; they must not overlap."""
        for s, e, new in sorted(edits, reverse=True):
            self.edit(s, e, new)


def sanitising_edits(text: str) -> list[Edit]:
    """Personal data replaced by placeholders, as edits; overlapping spans become one."""
    runs: list[list] = []
    for k, s, e in pii.base_spans(text):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e, pii.MARKS[k]])
    return [tuple(r) for r in runs]


_OUT = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_after", pa.int64()), ("n_chars_after", pa.int64()), ("n_chars_encoded", pa.int64()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))]
COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long, leaf_chars array<int>, leaf_tokens array<int>"


def edited_counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = sanitising_edits, tokenizer_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Counts before and after the edits that ``edits_of`` makes in each text, and the trees' leaves afterwards.

    doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded (characters
    encoded again for the edits), leaf_chars, leaf_tokens. Null text is empty; rows with one
    doc_id are counted each on its own; other columns are ignored. No rows give none.
    """
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                tree = CountTree(t, enc, leaf)
                before, tree.encoded = tree.total, 0
                edits = edits_of(t)
                tree.edits(edits)
                rows.append((d, before, len(edits), tree.total, int(tree.chars[1]), tree.encoded, *tree.kept()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return d.mapInArrow(lean(counted), COUNTS)


def recount(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer_path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Counts after further edits (doc_id, start, end, new), from kept leaves (doc_id, leaf_chars, leaf_tokens).

    Only documents with edits are read again, and of those only touched leaves are encoded;
    doc_id must be unique. Same columns as :func:`edited_counts`.
    """
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for d, t, chars, tokens, es in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                tree = CountTree.restored(t or "", chars or [0], tokens or [0], enc, leaf)
                before = tree.total
                tree.edits([(e["start"], e["end"], e["new"]) for e in es])
                rows.append((d, before, len(es), tree.total, int(tree.chars[1]), tree.encoded, *tree.kept()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])

    e = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "new")).alias("edits"))
    j = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")).join(trees.select("doc_id", "leaf_chars", "leaf_tokens"), "doc_id").join(e, "doc_id")
    return j.select("doc_id", "_text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(lean(counted), COUNTS)
