"""A shuffle of NumPy columns: entries are dealt to buckets and travel packed, many to a row.

``deal`` turns columns into (bucket, payload) rows, ``shuffled`` brings all rows of a
bucket to one task, one bucket after another, and ``buckets`` yields each bucket's
columns. There are several buckets for each partition, so that partitions even out
and a task holds one bucket at a time. Their number follows from the bytes read, so that
a bucket does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

ROWS = "bucket int, payload binary"
BUCKETS_A_PARTITION = 4
#: Bytes read for each shuffle partition; entries are a few times their text.
PARTITION_BYTES = 64 << 20


def n_buckets(df: DataFrame) -> int:
    """Buckets for what is dealt from ``df``: by the bytes of the tables it reads (as far as Spark knows them), and as many as shuffle partitions ask for at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # an unknown size counts as the greatest number
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return BUCKETS_A_PARTITION * max(least, -(-size // PARTITION_BYTES))


def deal(bucket: np.ndarray, columns: list[np.ndarray], blob: tuple[np.ndarray, np.ndarray, bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS. blob: starts and lengths of each entry's bytes in one buffer, which travel along."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    if not len(b):
        return
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
    names, payloads = [], []
    size = 0
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        i = order[s:e]
        parts = [np.array([e - s], "<i8").tobytes(), *(np.ascontiguousarray(c[i]).tobytes() for c in columns)]
        if blob is not None:
            starts, lengths, data = blob
            parts += [lengths[i].astype("<i4").tobytes(), *(data[x : x + n] for x, n in zip(starts[i].tolist(), lengths[i].tolist(), strict=True))]
        names.append(int(b[s]))
        payloads.append(b"".join(parts))
        size += len(payloads[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])
            names, payloads, size = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def shuffled(dealt: DataFrame, n: int) -> DataFrame:
    """``n`` buckets in their partitions."""
    return dealt.repartition(n // BUCKETS_A_PARTITION, "bucket").sortWithinPartitions("bucket")


def _open(payloads: list[bytes], types: list[str], blob: bool) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    cols: list[list[np.ndarray]] = [[] for _ in types]
    sizes, data = [], []
    for p in payloads:
        n, at = int(np.frombuffer(p, "<i8", 1)[0]), 8
        for c, t in zip(cols, types, strict=True):
            c.append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
        if blob:
            sizes.append(np.frombuffer(p, "<i4", n, at))
            data.append(np.frombuffer(p, np.uint8, offset=at + 4 * n))
    return [np.concatenate(c) for c in cols], [np.concatenate(sizes), np.concatenate(data)] if blob else None


def buckets(batches: Iterator[pa.RecordBatch], types: list[str], blob: bool = False) -> Iterator[tuple[list[np.ndarray], list[np.ndarray] | None]]:
    """Each bucket's columns (and its entries' lengths and bytes); rows come sorted by bucket."""
    now, held = None, []
    for b in batches:
        for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != now and held:
                yield _open(held, types, blob)
                held = []
            now = k
            held.append(p)
    if held:
        yield _open(held, types, blob)


def through(dealt: DataFrame, n: int, types: list[str], reduce: Callable[[list[np.ndarray], list[np.ndarray] | None], Iterator[pa.RecordBatch]], schema: str, blob: bool = False) -> DataFrame:
    """Shuffle and apply ``reduce`` to each of ``n`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, data in buckets(batches, types, blob):
            yield from reduce(columns, data)

    return shuffled(dealt, n).mapInArrow(lean(run), schema)
