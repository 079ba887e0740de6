"""Suffix-array dedup by a depth-limited radix sort, most significant digit first.

A window is the first ``depth`` bytes of a suffix. Windows that share content must be
found among all of the corpus without shipping each of them, so the first digit is the
*anchor*: the k-gram inside the window whose hash is least. Equal windows have equal
anchors at equal places, and neighbouring windows mostly share theirs, so that a
*block* - the run of windows with one anchor - stands for them all:

1. Blocks are dealt by anchor. Blocks that are equal as a whole repeat all their
   windows (every block but the earliest is removed). An anchor with a single kind of
   block is settled: most suffixes end here.
2. Only where an anchor has different blocks are their bytes fetched, and their
   windows ordered by 8-byte digits down to the depth and no further; windows that are
   alone in their group drop out after each pass. Groups left are exactly the repeated
   windows.

Repeats inside a task are settled there, so a hot block reaches a bucket once a task.
An anchor with many kinds of blocks in one task is *busy*: its windows are dealt one by
one, by their content. Block equality rests on two 64-bit hashes; windows are compared
byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import packed
from .common import lean, runs_of, saved, small_batches

K = 32
CHUNK = 1 << 17
#: Different blocks of one anchor in one task beyond which it is busy.
BUSY = 64
#: Blocks that a task gathers before it settles and deals them.
HOLD = 200_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, 24, dtype=np.uint64) | np.uint64(1)

SPAN, BLOCK = 1, 2
ROWS = "kind int, doc long, a long, b long, key long, busy boolean"
_ROWS = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("busy", pa.bool_())])
_BLOCKS = ["<u8", "<u8", "<i8", "<i8", "<i4", "?"]  # anchor, content, doc, start, windows, busy


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes from each place (k a power of two)."""
    h, n, j = _BYTE[data], 1, 0
    while n < k:
        h = h[:-n] * _ODD[j] + h[n:]
        if n >= 4:
            h = _mix(h)
        n, j = 2 * n, j + 1
    return h


def blocks_of(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, start, windows) of the blocks of texts that lie one behind another in ``data`` and end at ``ends``."""
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    if n < depth:
        return none
    h = _hashes(data)
    width = depth - K + 1  # k-grams in a window
    least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for e in ends.tolist():  # windows that would cross the end of a text
        valid[max(0, e - depth + 1) : e] = False
    s = np.flatnonzero(valid)
    if not len(s):
        return none
    a = anchor[s]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)])
    first, last = s[new], s[np.r_[new[1:], len(s)] - 1]
    end = last + depth
    content = (last - first).astype(np.uint64)
    for at in (first, first + K, first + 2 * K, end - K, end - 2 * K, end - 3 * K):  # these cover the block
        content = _mix(content * _ODD[20] + h[at])
    return h[a[new]], content, first, (last - first + 1).astype(np.int32)


def _merge(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each document."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    rank = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(b + (rank << 32)) - (rank << 32)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])])
    return doc[new], a[new], reach[np.r_[new[1:], len(doc)] - 1]


def _spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    doc, a, b = _merge(doc, a, b)
    yield from _rows(SPAN, doc, a, b, np.zeros(len(doc), np.int64), np.zeros(len(doc), bool))


def _rows(kind: int, doc, a, b, key, busy) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(doc), 1 << 16):
        i = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc[i]), kind, np.int32)), *(pa.array(np.ascontiguousarray(c[i]).astype(t)) for c, t in ((doc, np.int64), (a, np.int64), (b, np.int64))), pa.array(np.ascontiguousarray(key[i]).view(np.int64)), pa.array(busy[i])], schema=_ROWS)


def settle(anchor, content, doc, start, windows, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices of the earliest of each kind of block, in order of anchor and content, and the spans of the others."""
    order = np.lexsort((start, doc, content, anchor))
    k, c = anchor[order], content[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
    first = order[new]
    mine = first[np.cumsum(new) - 1]  # the earliest of each one's kind
    again = order[(~new) & ((doc[order] != doc[mine]) | (start[order] != start[mine]))]
    return first, (doc[again], start[again], start[again] + windows[again] + depth - 1)


def _anchored(depth: int, n_buckets: int):
    """Mapper: blocks of whole texts, settled inside the task, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            anchor, content, doc, start, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            first, (sd, sa, sb) = settle(anchor, content, doc, start, windows, depth)
            anchor, content, doc, start, windows = (c[first] for c in (anchor, content, doc, start, windows))
            s, length = runs_of(anchor)
            busy = np.repeat(length > BUSY, length)
            # of a busy anchor, two blocks tell its bucket so; the others go past it
            place = np.arange(len(anchor)) - np.repeat(s, length)
            tell = ~busy | (place < 2)
            away = np.flatnonzero(~tell)
            sd, sa, sb = _merge(sd, sa, sb)
            # spans and blocks that need no bucket travel as entries with no windows, or as busy ones with a bucket of their own document
            yield from packed.deal((doc_bucket(sd, n_buckets)), [np.zeros(len(sd), "<u8"), sb.astype("<u8"), sd, sa, np.zeros(len(sd), "<i4"), np.zeros(len(sd), bool)])
            yield from packed.deal(doc_bucket(doc[away], n_buckets), [anchor[away], np.zeros(len(away), "<u8"), doc[away], start[away], -windows[away], np.ones(len(away), bool)])
            i = np.flatnonzero(tell)
            yield from packed.deal((anchor[i] >> np.uint64(20)).astype(np.int64) % n_buckets, [anchor[i], content[i], doc[i], start[i], windows[i], busy[i]])

        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            k = 0
            while k < len(raw):
                group, size = [], 0
                while k < len(raw) and (not group or size + len(raw[k]) <= CHUNK):
                    if len(raw[k]) >= depth:
                        group.append(k)
                        size += len(raw[k])
                    k += 1
                for data, ends, docs, offsets in _chunks([raw[i] for i in group], [ids[i] for i in group], depth):
                    anchor, content, first, windows = blocks_of(data, ends, depth)
                    if len(first):
                        i = np.searchsorted(ends, first, "right")
                        begin = np.r_[0, ends[:-1]]
                        held.append((anchor, content, docs[i], first - begin[i] + offsets[i], windows))
                        n += len(first)
            if n > HOLD:
                yield from flush()
                n = 0
        yield from flush()

    return run


def _chunks(raw: list[bytes], ids: list[int], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, docs, offsets); a text longer than a chunk is cut so that no window is lost."""
    if len(raw) == 1 and len(raw[0]) > 2 * CHUNK:
        for s in range(0, len(raw[0]) - depth + 1, CHUNK):
            part = np.frombuffer(raw[0][s : s + CHUNK + depth - 1], np.uint8)
            yield part, np.array([len(part)]), np.array(ids, np.int64), np.array([s])
    elif raw:
        yield np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), np.array(ids, np.int64), np.zeros(len(raw), np.int64)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by_anchor(depth: int):
    """Reducer: settles blocks among tasks, and names those whose windows must be compared."""

    def reduce(columns, _) -> Iterator[pa.RecordBatch]:
        anchor, content, doc, start, windows, busy = columns
        span = windows == 0
        yield from _spans(doc[span], start[span], content[span].astype(np.int64))
        past = windows < 0
        yield from _rows(BLOCK, doc[past], start[past], -windows[past], anchor[past], busy[past])
        i = np.flatnonzero(windows > 0)
        if not len(i):
            return
        anchor, content, doc, start, windows, busy = (c[i] for c in (anchor, content, doc, start, windows, busy))
        first, (sd, sa, sb) = settle(anchor, content, doc, start, windows, depth)
        s, length = runs_of(anchor[first])
        some = np.repeat(np.maximum.reduceat(busy[first].astype(np.int8), s) > 0, length)
        # equal blocks are told apart by their anchor's flag only among the earliest, so look at all
        flagged = np.unique(anchor[busy])
        some |= np.isin(anchor[first], flagged)
        mixed = some | np.repeat(length > 1, length)
        yield from _spans(sd, sa, sb)
        j = first[mixed]
        yield from _rows(BLOCK, doc[j], start[j], windows[j].astype(np.int64), anchor[j], some[mixed])

    return reduce


_WINDOWS = ["<u8", "<i8", "<i8"]  # key, doc, start


def _fetch(depth: int, n_buckets: int):
    """Mapper: the bytes of the named blocks; windows of busy anchors one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, start, blob, size = [], [], [], [], 0
        seen: dict[bytes, tuple[int, int]] = {}
        over: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for w, (d, s) in seen.items():
                key.append(xxhash.xxh3_64_intdigest(w))
                doc.append(d)
                start.append(s)
                blob.append(w)
            for d, s in over:  # an entry without bytes is a span
                key.append(d & (2**64 - 1))
                doc.append(d)
                start.append(s)
                blob.append(b"")
            lengths = np.array([len(x) for x in blob], np.int64)
            k = np.array(key, np.uint64)
            yield from packed.deal((_mix(k) % np.uint64(n_buckets)).astype(np.int64), [k, np.array(doc, np.int64), np.array(start, np.int64)], (np.cumsum(lengths) - lengths, lengths, b"".join(blob)))
            for x in (key, doc, start, blob, over):
                x.clear()
            seen.clear()
            size = 0

        for b in batches:
            for d, raw, want in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for w in want:
                    s, n = w["a"], w["b"]
                    if not w["busy"]:
                        key.append(w["key"] & (2**64 - 1))
                        doc.append(d)
                        start.append(s)
                        blob.append(raw[s : s + n + depth - 1])
                        size += n + depth
                        continue
                    for at in range(s, s + n):
                        window = raw[at : at + depth]
                        old = seen.get(window)
                        if old is None or (d, at) < old:
                            seen[window] = (d, at)
                            size += 3 * depth * (old is None)
                        if old is not None and old != (d, at):
                            over.append(max(old, (d, at)))
            if size > 32 << 20:
                yield from flush()
        if key or seen or over:
            yield from flush()

    return run


def repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, group) of the windows that are not alone: radix passes over 8-byte digits, most significant first."""
    which = np.arange(len(at))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for d in range(0, depth, 8):
        if not len(which):
            break
        digit = np.ascontiguousarray(words[at[which] + d]).view(">u8").ravel().astype(np.uint64)
        if depth - d < 8:
            digit >>= np.uint64(8 * (8 - (depth - d)))
        order = np.lexsort((digit, group))
        which, group, digit = which[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        name = np.cumsum(new) - 1
        alive = np.bincount(name)[name] > 1
        which, group = which[alive], name[alive]
    return which, group


def _compare(depth: int):
    """Reducer: orders the windows of each bucket and names the repeated ones' spans."""

    def reduce(columns, data) -> Iterator[pa.RecordBatch]:
        key, doc, start = columns
        lengths, raw = data
        span = lengths == 0
        yield from _spans(doc[span], start[span], start[span] + depth)
        i = np.flatnonzero(~span)
        base = (np.cumsum(lengths) - lengths)[i]
        key, doc, start, n = key[i], doc[i], start[i], lengths[i].astype(np.int64) - depth + 1
        by = np.argsort(key, kind="stable")
        _, group_of = np.unique(key, return_inverse=True)
        s, length = runs_of(key[by])
        lo = 0
        while lo < len(s):  # whole keys, up to some hundred thousand windows at a time
            hi, size = lo, 0
            while hi < len(s) and (hi == lo or size < 300_000):
                size += int(n[by[s[hi] : s[hi] + length[hi]]].sum())
                hi += 1
            e = by[s[lo] : s[hi - 1] + length[hi - 1]]
            entry = np.repeat(e, n[e])
            off = np.arange(len(entry)) - np.repeat(np.cumsum(n[e]) - n[e], n[e])
            which, group = repeated(raw, base[entry] + off, group_of[entry], depth)
            d, a = doc[entry[which]], start[entry[which]] + off[which]
            order = np.lexsort((a, d, group))
            d, a, g = d[order], a[order], group[order]
            if len(g):
                new = np.r_[True, g[1:] != g[:-1]]
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (d != d[head]) | (a != a[head])
                yield from _spans(d[later], a[later], a[later] + depth)
            lo = hi

    return reduce


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, raw): ``doc`` orders the documents and names each text once.

    It is doc_id, unless a doc_id is null or stands with different texts; then the
    distinct (doc_id, text) pairs are numbered in order (null first, then by digest): by
    range, then by place in it.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    by_id = d.select("doc_id", F.xxhash64("raw").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    if by_id.where(F.col("doc_id").isNull() | (F.col("lo") != F.col("hi"))).isEmpty():
        return d.withColumn("doc", F.col("doc_id"))
    d = d.withColumn("digest", F.sha2("raw", 256))
    order = [F.asc_nulls_first("doc_id"), F.col("digest")]
    names = d.select("doc_id", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    n = saved(names, "names").select(F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_digest"), (F.shiftleft(F.col("part").cast("long"), 32) + place).alias("doc"))
    return d.join(n, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("digest") == F.col("_digest"))).select("doc_id", "doc", "raw")


def removed_spans(d: DataFrame, depth: int) -> DataFrame:
    """(doc, a, b): byte spans to remove, from ``numbered`` documents; they may overlap."""
    n = packed.n_buckets(d)
    first = saved(packed.through(d.select("doc", "raw").mapInArrow(lean(_anchored(depth, n)), packed.ROWS), n, _BLOCKS, _by_anchor(depth), ROWS), "blocks")
    spans = first.where(F.col("kind") == SPAN).select("doc", "a", "b")
    named = first.where(F.col("kind") == BLOCK).groupBy("doc").agg(F.collect_list(F.struct("a", "b", "key", "busy")).alias("want"))
    # rows that repeat a document fetch the same bytes of the same places again, which changes nothing
    fetched = d.select("doc", "raw").join(named, "doc").select("doc", "raw", "want").mapInArrow(lean(_fetch(depth, n)), packed.ROWS)
    second = saved(packed.through(fetched, n, _WINDOWS, _compare(depth), ROWS, blob=True), "windows")
    return spans.unionByName(second.select("doc", "a", "b"))


def _applied(out_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, raw, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                parts, at, gone, n = [], 0, 0, 0
                end = -1
                for s, e in sorted((x["a"], x["b"]) for x in spans or []):
                    n += s > end
                    end = max(end, e)
                    if e > at:
                        s = max(s, at)
                        parts.append(raw[at:s])
                        gone += e - s
                        at = e
                parts.append(raw[at:])
                kept = b"".join(parts)
                rows.append((d, len(raw), gone, n, kept if out_text else hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary() if out_text else pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if out_text else "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, depth: int = 100, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (or, with ``text``, the kept bytes): one row per row of ``docs``.

    Null text is empty. Equal rows are one document and get one result each; a doc_id with
    different texts names different documents, ordered by digest, a null doc_id comes
    first; other columns are ignored. No rows give none.
    """
    if depth < 3 * K:
        raise ValueError(f"depth must be at least {3 * K} bytes")
    small_batches(docs.sparkSession)
    d = numbered(docs)
    spans = removed_spans(d, depth).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    last = "kept binary" if text else "kept_sha256 string"
    return d.join(spans, "doc", "left").select("doc_id", "raw", "spans").mapInArrow(lean(_applied(text)), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
