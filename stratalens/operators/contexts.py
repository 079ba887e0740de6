"""Best neighbours by positive pointwise mutual information, without a row for each pair of words.

Tokens become numbers by falling marginal count, then by token, so that a number tells
its marginal by a short table of steps and numbers of one marginal stand in the tokens'
order. A task counts the cells of a chunk of texts and leaves out those that bounds show
to be no word's best: a cell's count elsewhere is at most what either word's marginal has
left, and a word's k-th best so far only rises. What is left travels packed, by word; words
with very many cells are spread over several groups.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import forget, saved
from .text import tokens

#: Tokens after which a chunk is closed; a longer text makes a longer chunk.
CHUNK = 1 << 20
#: Pairs of places, counted from both sides, for each group of cells, and of one word in one group.
GROUP, SPREAD = 1 << 24, 1 << 22
#: Passes over chunks and over blocks, each of which shuffles its share of them.
PASSES = 4
#: More than Spark's rounding to nine digits and the logarithm's error can move a value.
SLACK = 3e-9

_CODED = pa.schema([("chunk", pa.int64()), ("token", pa.string()), ("place", pa.int32()), ("m", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("n_ids", pa.int64()), ("n_texts", pa.int64())])
_BLOCKS = pa.schema([("bucket", pa.int32()), ("rows", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
_CELLS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("v", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of rows that are equal in all keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return np.flatnonzero(new)


def _coded(window: int, chunk: int):
    """Mapper: token lists to chunks: a row with the packed numbers, and one for each distinct token with its part of the marginal."""

    def close(values: list[pa.Array], sizes: list[np.ndarray], name: int) -> Iterator[pa.RecordBatch]:
        d = pa.chunked_array(values, pa.string()).combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        ids, lengths = d.indices.to_numpy(zero_copy_only=False), np.concatenate(sizes)
        end = np.repeat(np.cumsum(lengths), lengths)
        at = np.arange(len(ids))
        near = np.minimum(at - (end - np.repeat(lengths, lengths)), window) + np.minimum(end - 1 - at, window)
        m = np.bincount(ids, near, len(d.dictionary)).astype(np.int64) * 2
        order = np.argsort(-np.bincount(ids, minlength=len(m)), kind="stable")  # small numbers pack better
        place = np.empty(len(m), np.int32)
        place[order] = np.arange(len(m))
        k, empty = len(m), lambda t, n=1: pa.nulls(n, t)
        one = [pa.array([name]), empty(pa.string()), empty(pa.int32()), empty(pa.int64()), pa.array([_pack(place[ids])], pa.binary()), pa.array([_pack(lengths)], pa.binary()), pa.array([len(ids)]), pa.array([len(lengths)])]
        yield pa.RecordBatch.from_arrays(one, schema=_CODED)
        rows = pa.Table.from_arrays([pa.array(np.full(k, name)), d.dictionary, pa.array(place), pa.array(m), empty(pa.binary(), k), empty(pa.binary(), k), empty(pa.int64(), k), empty(pa.int64(), k)], schema=_CODED)
        yield from rows.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        values, sizes, held = [], [], 0
        for b in batches:
            lists = b.column(0)
            offsets = lists.offsets.to_numpy()
            lo = 0
            while lo < len(lists):
                # texts up to the first one that fills the chunk
                hi = min(int(np.searchsorted(offsets, offsets[lo] + chunk - held)), len(lists))
                hi = max(hi, lo + 1)
                values.append(lists.values.slice(offsets[lo], offsets[hi] - offsets[lo]))
                sizes.append(np.diff(offsets[lo : hi + 1]).astype(np.int64))
                held += int(offsets[hi] - offsets[lo])
                lo = hi
                if held >= chunk:
                    yield from close(values, sizes, name)
                    values, sizes, held, name = [], [], 0, name + 1
        if held:
            yield from close(values, sizes, name)

    return run


def _bars(sides: list[np.ndarray], low: np.ndarray, k: int) -> np.ndarray:
    """By token, what a value must reach to be among the ``k`` best of those of at least ``low``; a cell counts for each of its ``sides``."""
    bits, size = 36, sum(np.bincount(a, minlength=max(int(x.max()) + 1 for x in sides)) for a in sides)
    top = (1 << bits) - 1
    key, at = np.empty(sum(map(len, sides)), np.int64), 0
    falling = top - (low * 1e9).astype(np.int64)
    for a in sides:
        part = key[at : at + len(a)]
        part[:] = a
        part <<= bits
        part |= falling[len(falling) - len(a) :]
        at += len(a)
    key.sort()
    bar, full = np.full(len(size), -np.inf), size >= k
    bar[full] = (top - (key[(np.cumsum(size) - size)[full] + k - 1] & top)) * 1e-9 - SLACK
    return bar


def _unneeded(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Places of cells with whole counts that ``k`` others of the same count and marginal ``m`` of b come before by token."""
    i = np.lexsort((b, n, a))
    if not len(i):
        return i
    first = _runs(a[i], n[i], m[i])
    return i[np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) >= k]


class _Marginals:
    """Marginal counts by number, as steps; and the measure."""

    def __init__(self, counts: dict[int, int]):
        self.m = np.array(sorted(counts, reverse=True), np.int64)
        size = np.array([counts[x] for x in self.m.tolist()], np.int64)
        self.first = np.cumsum(size) - size
        self.total = int(sum(int(x) * int(s) for x, s in zip(self.m, size)))

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.m[np.searchsorted(self.first, ids, "right") - 1]

    def ppmi(self, n: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
        whole = len(n) and int(n.max()) * self.total < 1 << 63
        product = (n * self.total).astype(float) if whole else n * float(self.total)
        return np.maximum(np.log(product / (ma.astype(float) * mb + 1e-10)), 0.0)


def _cells_of(text: pa.Table, names: pa.Table, marginals: _Marginals, window: int, k: int, buckets: int) -> pa.Table:
    """Blocks of the cells of one chunk that may be among the best, by bucket."""
    ids, lengths = (_unpack(text[c][0].as_py(), text[s][0].as_py()) for c, s in (("ids", "n_ids"), ("lengths", "n_texts")))
    name = np.empty(names.num_rows, np.int64)
    name[names["place"].to_numpy()] = names["id"].to_numpy()
    order = np.argsort(name)
    rank = np.empty(len(name), np.int64)
    rank[order] = np.arange(len(name))
    name, ids = name[order], rank[ids]
    m = marginals.of(name)
    text_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    pair, at = np.empty(int(sum(np.maximum(lengths.astype(np.int64) - d, 0).sum() for d in range(1, window + 1))), np.int64), 0
    for d in range(1, window + 1):
        same = text_of[d:] == text_of[:-d]
        x, y = ids[:-d][same], ids[d:][same]
        pair[at : at + len(x)] = np.minimum(x, y) << 32 | np.maximum(x, y)
        at += len(x)
    del text_of, ids, same, x, y
    pair.sort()
    first = _runs(pair)
    n = np.diff(np.r_[first, len(pair)])
    pair = pair[first]
    del first
    x, y = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    # cells of a token with itself come first: they have one side only
    order = np.argsort(x != y, kind="stable")
    x, y, n = x[order], y[order], 2 * n[order]
    del pair, order
    own = int(np.count_nonzero(x == y))
    n[:own] *= 2
    here = np.bincount(x, n, len(m)) + np.bincount(y[own:], n[own:], len(m))
    rest = m - here.astype(np.int64)  # of each token's marginal, in other chunks
    bar = _bars([x, y[own:]], marginals.ppmi(n, m[x], m[y]), k) if len(x) else np.zeros(0)
    more = np.minimum(rest[x], rest[y])
    high = marginals.ppmi(n + more, m[x], m[y])
    sides = []
    for a, b, z, v, left in ((x, y, n, high, more), (y[own:], x[own:], n[own:], high[own:], more[own:])):
        keep = np.flatnonzero(v >= bar[a]) if len(a) else np.zeros(0, np.int64)
        whole = keep[left[keep] == 0]
        out = whole[_unneeded(a[whole], b[whole], z[whole], m[b[whole]], k)]
        keep = np.setdiff1d(keep, out, assume_unique=True)
        sides.append((a[keep], b[keep], z[keep]))
    del x, y, high, more
    x, y, n = (np.concatenate(c) for c in zip(*sides))
    a, b, ma = name[x], name[y], m[x]
    # b's own hash, so that what a widespread word is spread by does not depend on the chunk
    spread = ((b * 0x9E3779B1) & 0xFFFFFFFF) % (1 + ma // (2 * SPREAD))
    bucket = (((a * 0x9E3779B1 + spread * 0x85EBCA77) & 0xFFFFFFFF) >> 7) % buckets
    bits = len(m).bit_length()
    if 2 * bits + buckets.bit_length() < 64:  # one key sorts faster than three
        order = np.argsort((bucket << bits | x) << bits | y)
    else:
        order = np.lexsort((b, a, bucket))
    a, b, n, bucket = a[order], b[order], n[order], bucket[order]
    starts = _runs(bucket) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for lo, hi in zip(starts, np.r_[starts[1:], len(bucket)]):
        s, t, new = a[lo:hi], b[lo:hi].copy(), np.ones(hi - lo, bool)
        new[1:] = s[1:] != s[:-1]
        step = np.where(new[1:], t[1:], t[1:] - t[:-1])
        t[1:] = step
        rows.append((int(bucket[lo]), int(hi - lo), _pack(np.diff(s, prepend=0)), _pack(t), _pack(n[lo:hi])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _BLOCKS)], schema=_BLOCKS)


def _best_of(blocks: pa.Table, marginals: _Marginals, k: int) -> pa.Table:
    """Cells of one bucket with whole counts that can be among the best."""
    keys, counts = [], []
    for r in blocks.to_pylist():
        a, t, n = (_unpack(r[c], r["rows"]).astype(np.int64) for c in ("a", "b", "n"))
        first = np.flatnonzero(a > 0) if len(a) else a
        first = first if len(first) and first[0] == 0 else np.r_[0, first]
        at = np.cumsum(t)
        b = at - np.repeat((at - t)[first], np.diff(np.r_[first, len(t)]))
        keys.append(np.cumsum(a) << 32 | b)
        counts.append(n)
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    first = _runs(key)
    n, key = np.add.reduceat(n, first), key[first]
    a, b = key >> 32, key & 0xFFFFFFFF
    ma, mb = marginals.of(a), marginals.of(b)
    v = marginals.ppmi(n, ma, mb)
    own = np.cumsum(np.r_[0, a[1:] != a[:-1]])
    keep = np.flatnonzero(v >= _bars([own], v, k)[own])
    keep = np.delete(keep, _unneeded(own[keep], b[keep], n[keep], mb[keep], k))
    return pa.Table.from_arrays([pa.array(x[keep]) for x in (a, b, n, v)], schema=_CELLS)


def ppmi_best(docs: DataFrame, k: int = 5, window: int = 5, digits: int = 9, text_col: str = "text", chunk: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """(a, b, n, ppmi, rank): each token's ``k`` best neighbours by rounded PPMI over all tokens, ties by token.

    Cells count as in :func:`stratalens.operators.text.cooccurrence`; results are exact.
    Intermediate tables go to the shared folder and are deleted when they have been read.
    Up to 2**31 distinct tokens.
    """
    spark = docs.sparkSession
    coded = saved(docs.select(tokens(F.col(text_col)).alias("t")).mapInArrow(_coded(window, chunk), _ddl(_CODED)), "coded", "zstd", True)
    words = coded.where("token IS NOT NULL").groupBy("token").agg(F.sum("m").alias("m"))
    words = words.repartitionByRange(F.desc("m"), "token").sortWithinPartitions(F.desc("m"), "token").withColumn("row", F.monotonically_increasing_id())
    words = saved(words, "words", "zstd", True)
    marginals = _Marginals({r["m"]: r["c"] for r in words.groupBy("m").agg(F.count("*").alias("c")).collect()})  # as many rows as distinct counts, at most the root of twice their sum
    parts = sorted((r["p"], r["c"]) for r in words.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("c")).collect())  # one row for each written partition
    size = sum(c for _, c in parts)
    if size >= 1 << 31:
        raise ValueError(f"{size} distinct tokens; up to 2**31 have numbers")
    base = np.cumsum([0, *[c for _, c in parts]]).tolist()
    bases = spark.createDataFrame([(p, b - (p << 33)) for (p, _), b in zip(parts, base)], "p long, base long")
    words = words.join(F.broadcast(bases), F.shiftright("row", 33) == F.col("p")).select("token", (F.col("row") + F.col("base")).alias("id"))

    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-marginals.total // 2 // GROUP), 1)
    sent = spark.sparkContext.broadcast(marginals)

    def cells(text: pa.Table, names: pa.Table) -> pa.Table:
        return _cells_of(text, names, sent.value, window, k, buckets)

    def best(blocks: pa.Table) -> pa.Table:
        return _best_of(blocks, sent.value, k)

    texts = coded.where("ids IS NOT NULL").select("chunk", "ids", "lengths", "n_ids", "n_texts")
    names = coded.where("token IS NOT NULL").select(F.col("chunk").alias("of_chunk"), "place", "token").join(words, "token").select("of_chunk", "place", "id")
    names = saved(names, "names", "zstd", True)
    # a part of the chunks, then of the buckets, at a time, so that little is on disk twice
    parts = []
    for i in range(PASSES):
        t, w = (x.where(F.pmod(F.xxhash64(c), F.lit(PASSES)) == i).groupBy(c) for x, c in ((texts, "chunk"), (names, "of_chunk")))
        parts.append(saved(t.cogroup(w).applyInArrow(cells, _ddl(_BLOCKS)), "cells", "snappy", True))
    forget(coded)
    forget(names)
    blocks = functools.reduce(DataFrame.unionAll, parts)
    found = [saved(blocks.where(F.col("bucket") % PASSES == i).groupBy("bucket").applyInArrow(best, _ddl(_CELLS)), "best", "zstd", True) for i in range(PASSES)]
    for part in parts:
        forget(part)
    parts, found = found, functools.reduce(DataFrame.unionAll, found)
    named = saved(found.join(words.select(F.col("id").alias("b"), F.col("token").alias("token_b")), "b").select("a", "token_b", "n", "v"), "named", "zstd", True)
    for part in parts:
        forget(part)
    named = named.join(words.select(F.col("id").alias("a"), "token"), "a").withColumn("ppmi", F.round("v", digits))
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ppmi"), "token_b"))
    return named.withColumn("rank", r).where(F.col("rank") <= k).select(F.col("token").alias("a"), F.col("token_b").alias("b"), "n", "ppmi", "rank")
