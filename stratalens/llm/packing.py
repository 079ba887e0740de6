"""Packing: bounded-space online best-fit into windows of fixed length.

Every partition keeps ``n_open`` open windows. A document's full windows go out at
once; its rest is placed into the open window that it fills best, and if it fits in
none, the fullest open window is emitted. What stays open at the end of a partition
is merged: the leftovers of many partitions meet in tasks of Spark's advisory size and
are packed again by the same rule, and what is still open then is cut into lengths
that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, small_batches, texts, to_batches
from .tokenizer import default_path, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
#: sequence_id = task number << SHIFT | running number; merged sequences have MERGED set.
SHIFT, MERGED = 32, 1 << 61


class Windows:
    """``n_open`` open windows of ``size`` tokens; ``put`` returns an emitted window or None."""

    def __init__(self, size: int, n_open: int):
        self.size, self.n_open = size, n_open
        self.fill: list[int] = []
        self.held: list[list] = []

    def put(self, piece, length: int) -> list | None:
        best, gap = -1, self.size + 1
        for k, f in enumerate(self.fill):
            if length <= self.size - f < gap:
                best, gap = k, self.size - f
        out = None
        if best < 0:
            if len(self.fill) >= self.n_open:
                full = max(range(len(self.fill)), key=self.fill.__getitem__)
                out = self.held.pop(full)
                self.fill.pop(full)
            self.fill.append(length)
            self.held.append([piece])
            return out
        self.held[best].append(piece)
        self.fill[best] += length
        if self.fill[best] == self.size:
            self.fill.pop(best)
            out = self.held.pop(best)
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Rows:
    """Collects pieces as columns; a sequence's offsets run from 0 without gaps."""

    def __init__(self):
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple], sequence_id: int | None) -> None:
        offset = 0
        for doc, start, length, crc, total, ids in pieces:
            self.rows.append((doc, start, length, crc, total, sequence_id, offset, ids if sequence_id is None else None))
            offset += length

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from to_batches(dict(zip(_PIECES.names, zip(*self.rows, strict=True), strict=True)), _PIECES)
            self.rows = []


def pack(docs: DataFrame, size: int = 2048, n_open: int = 64, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``size`` must be a power of two. Null text counts as empty (only the end id); rows
    with one doc_id are packed each on its own; other columns are ignored; no rows give none.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n_seq = encoder(path), TaskContext.get().partitionId() << SHIFT
        end, rows, windows = np.array([end_id], np.uint32), _Rows(), Windows(size, n_open)
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), enc.encode(texts(b)), strict=True):
                ids = np.concatenate([x, end])
                cut = len(ids) - len(ids) % size
                for s in range(0, cut, size):
                    rows.sequence([(d, s, size, _crc(ids[s : s + size]), len(ids), None)], n_seq)
                    n_seq += 1
                if cut < len(ids):
                    rest = ids[cut:]
                    full = windows.put((d, cut, len(rest), _crc(rest), len(ids), rest.astype("<u4").tobytes()), len(rest))
                    if full:
                        rows.sequence(full, n_seq)
                        n_seq += 1
            yield from rows.take()
        for held in windows.held:  # leftovers carry their ids and no sequence yet
            rows.sequence(held, None)
        yield from rows.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_seq = MERGED | TaskContext.get().partitionId() << SHIFT
        rows, windows = _Rows(), Windows(size, n_open)
        for b in batches:
            for r in b.to_pylist():
                full = windows.put((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]), r["length"])
                if full:
                    rows.sequence(full, n_seq)
                    n_seq += 1
            yield from rows.take()
        for held in windows.held:
            left = sum(p[2] for p in held)
            parts, now, room = [], [], 0
            for doc, start, length, _, total, raw in held:
                ids, at = np.frombuffer(raw, "<u4"), 0
                while at < length:
                    if not room:
                        room = 1 << (left.bit_length() - 1)
                    n = min(room, length - at)
                    now.append((doc, start + at, n, _crc(ids[at : at + n]), total, None))
                    at, room, left = at + n, room - n, left - n
                    if not room:
                        parts.append(now)
                        now = []
            for part in parts:
                rows.sequence(part, n_seq)
                n_seq += 1
        yield from rows.take()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = saved(d.mapInArrow(lean(place), PIECES), "packing")
    done = first.where(F.col("sequence_id").isNotNull())
    # longest first, so that best fit has small pieces to fill gaps with
    left = first.where(F.col("sequence_id").isNull()).repartition("doc_id", "start").sortWithinPartitions(F.desc("length"), "doc_id", "start")
    # saved, so that a piece keeps its sequence however often the result is read
    return done.unionByName(saved(left.mapInArrow(lean(merge), PIECES), "merged")).drop("ids")
