"""N-gram Jaccard join: universe partition, pigeonhole, one-deletion neighbourhoods.

A document's set holds its distinct 5-word shingles. Two sets of s <= t elements with
Jaccard >= 3/4 differ in at most (s + t) // 7 elements, where t <= 4s/3. For each size
band the universe of shingles is partitioned by hash into segments; a set has a
signature for each segment in which it has elements. If a set has more such segments
than a partner may differ in, one of them is equal in both: the pair meets there. A
set takes part in the scheme of its own band and, as the larger one, in those of the
bands that its smaller partners may lie in.

Allocation is by cost. A signature held by more than ``BUSY`` sets is too dear and is
not allotted: it gives nothing to the count of segments that a set needs (its holders
are only linked to one of them, so that groups of near copies come together early). A
signature that is busy among the texts of one task is settled there, and only its first
holder is dealt, so that no bucket holds a large group.
Sets left with too few segments are allotted the one-deletion neighbourhood of theirs
(elements of a segment but one), which counts double. What lacks segments even then -
mostly members of large groups of near copies - meets by its smallest elements (a
quarter of the set and one more) and is compared in blocks, for links between
different components only, of which each pair of blocks gives out a spanning forest.

Every candidate is verified on the whole sets. Joins that move texts or sets are
sort-merge joins at every size: none of their sides has a bound that would allow a
broadcast. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import lean, runs_of, saved, small_batches, texts, words_of
from .components import components

WIDTH = 5
BUSY = 16
#: Bands of sizes: band k holds 1 .. SMALL for k = 0, then grows by RATIO each.
SMALL, RATIO = 16, 16 / 9
#: Segments for each element of a band's largest set.
SHARE = 0.4
#: A link to a busy signature's first holder is tried if so many signatures speak for it.
SUPPORT = 4
HOLD = 200_000
#: Signatures of a bucket that are compared at a time.
PART = 40_000
#: Counts of elements by cell that are compared before sets are.
CELLS = 256
#: Sets in a block of the last comparison.
LEFT_BLOCK = 1024
#: Elements whose columns of that comparison are held at a time.
SLICE = 2048

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: _Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, none makes none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(width, n)
    key = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        key = key * _MUL[0] + h[j : j + n - w + 1]
    key = np.sort(_mix(key))
    return key[np.r_[True, key[1:] != key[:-1]]]


def band(size: np.ndarray | int) -> np.ndarray:
    """Band of each size."""
    s = np.maximum(np.asarray(size, np.float64), 1)
    return np.maximum(0, np.ceil(np.log(s / SMALL) / np.log(RATIO) - 1e-9)).astype(np.int64)


def top(k: int) -> int:
    """The largest size in a band."""
    return int(np.floor(SMALL * RATIO**k + 1e-6))


def segments(k: int) -> int:
    """Segments of a band's partition; 0: each element is a segment of its own."""
    return 0 if k == 0 else int(np.ceil(SHARE * top(k)))


def may_differ(size: int, k: int) -> int:
    """The most elements in which a set of ``size`` and a partner differ, of which the smaller one's band is k."""
    own = int(band(size))
    return (size + 4 * size // 3) // 7 if k == own else (size + min(size, top(k))) // 7


def schemes(size: int) -> range:
    """The bands whose schemes a set of ``size`` takes part in."""
    least = -(-3 * size // 4)
    return range(int(band(least)), int(band(size)) + 1)


def _segment(x: np.ndarray, k: int) -> np.ndarray:
    m = segments(k)
    return x if m == 0 else _mix(x ^ _mix(np.array([k + 1], np.uint64))) % np.uint64(m)


def split(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, element) sorted by segment, then element."""
    seg = _segment(x, k)
    order = np.lexsort((x, seg))
    return seg[order], x[order]


def signatures(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, elements) of each segment of ``x`` that has any; equal segments have equal signatures."""
    m, each = segments(k), _mix(x ^ _MUL[1])
    if m == 0:
        seg, total, n = x, each, np.ones(len(x), np.int64)
    else:
        of = _segment(x, k).astype(np.int64)
        count = np.bincount(of, minlength=m)
        # sums of 32-bit halves are exact in doubles, and do not depend on the order
        low, high = (np.bincount(of, half.astype(np.float64), m).astype(np.uint64) for half in (each & np.uint64(0xFFFFFFFF), each >> np.uint64(32)))
        held = np.flatnonzero(count)
        seg, total, n = held.astype(np.uint64), (low + (high << np.uint64(32)))[held], count[held]
    return _mix(_mix(total + n.astype(np.uint64) * _MUL[2]) ^ _mix(seg * _MUL[0] + np.uint64(k))), n


def neighbourhoods(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signature, mark, credit): each segment and each of it without one element, if any is left.

    mark: 4 times the segment's number, 2 if it has several elements, 1 for the whole.
    credit: 2 for each segment of several elements, 1 for each other one.
    """
    seg, e = split(x, k)
    start, n = runs_of(seg)
    each = _mix(e ^ _MUL[1])
    total = np.add.reduceat(each, start)
    number = np.arange(len(start))
    head = _mix(seg[start] * _MUL[0] + np.uint64(k))
    whole = _mix(_mix(total + n.astype(np.uint64) * _MUL[2]) ^ head)
    at = np.repeat(number, n)
    many = n[at] > 1
    less = _mix(_mix(total[at] - each + (n[at] - 1).astype(np.uint64) * _MUL[2]) ^ head[at])
    mark = np.r_[4 * number + 2 * (n > 1) + 1, 4 * at[many] + 2]
    return np.r_[whole, less[many]], mark, int(np.minimum(n, 2).sum())


# Rows that leave the buckets.
INFO, EQUAL, PAIR, STAR, DEAR = range(5)
ROWS = "kind int, a long, b long, c long"
_ROWS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
#: lo and hi make 40 bits of a signature (a bucket adds some more; collisions only cost a check);
#: hi is 255 for what is no signature. mark: whether it is busy, or the segment's number and whether it is whole.
_SIGNED = ["<u4", "u1", "<i8", "u1", "<i4"]  # lo, hi, doc, scheme, mark


def _rows(kind: int, a, b, c) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 1 << 16):
        i = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[i]), kind, np.int32)), *(pa.array(np.ascontiguousarray(x[i]).astype(np.int64)) for x in (a, b, c))], schema=_ROWS)


def _deal(sig: np.ndarray, doc: np.ndarray, scheme: np.ndarray, mark: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    yield from packed.deal(((sig >> np.uint64(40)) % np.uint64(n)).astype(np.int64), [(sig & np.uint64(0xFFFFFFFF)).astype("<u4"), ((sig >> np.uint64(32)) & np.uint64(0x7F)).astype("u1"), doc, scheme.astype("u1"), mark.astype("<i4")])


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _deal_notes(notes: list[tuple[int, int, int, int]], n: int) -> Iterator[pa.RecordBatch]:
    """(document, what, value, upper value).

    what is 0: the set's size; 1: a document with an equal set; ``HELD`` + scheme: its
    segments, or its credit; ``LOST`` + scheme: how many of them are too dear; ``MET`` + n: a
    document with which it shares n busy signatures (``MOST_MET`` or more).
    """
    d, what, value, far = (np.array(c, np.int64) for c in zip(*notes, strict=True))
    yield from packed.deal(_bucket(d, n), [(value & 0xFFFFFFFF).astype("<u4"), np.full(len(d), 255, "u1"), d, what.astype("u1"), far.astype("<i4")])


#: What notes say, see _deal_notes; there are 64 schemes at most.
HELD, LOST, MET = 2, 66, 130
MOST_MET = 100


def _settled(sig: np.ndarray, doc: np.ndarray, scheme: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(entries to deal, whether each is busy, notes for the others) of a task's signatures."""
    order = np.lexsort((doc, sig))
    start, length = runs_of(sig[order])
    busy = np.repeat(length > most, length)
    first = np.repeat(order[start], length)
    others = busy & (order != first)
    a, b, n = _count(doc[first[others]], doc[order[others]])
    notes = []
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        notes.append((y, MET + min(MOST_MET, k), x & 0xFFFFFFFF, x >> 32))
    d, q, n = _count(doc[order[others]], scheme[order[others]])
    notes += [(x, LOST + k, c, 0) for x, k, c in zip(d.tolist(), q.tolist(), n.tolist(), strict=True)]
    return order[~others], busy[~others], notes


def _signed(n_buckets: int, most: int):
    """Mapper: sets of whole texts; one of equal sets in the task gives its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Words(), {}
        sig, doc, scheme = [], [], []
        notes: list[tuple[int, int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sig:
                x, d, k = np.concatenate(sig), np.concatenate(doc), np.concatenate(scheme)
                i, busy, more = _settled(x, d, k, most)
                notes.extend(more)
                yield from _deal(x[i], d[i], k[i], busy.astype(np.int64), n_buckets)
                for c in (sig, doc, scheme):
                    c.clear()
                held = 0
            if notes:
                yield from _deal_notes(notes, n_buckets)
                notes.clear()

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                x = shingles(words_of(t), hashes)
                notes.append((d, 0, len(x), 0))
                if not len(x):
                    continue
                name = xxhash.xxh3_128_digest(x.tobytes())
                twin = seen.setdefault(name, d) if len(seen) < 100_000 else d
                if twin != d:
                    notes.append((d, 1, twin & 0xFFFFFFFF, twin >> 32))
                    continue
                for k in schemes(len(x)):
                    s, _ = signatures(x, k)
                    sig.append(s)
                    doc.append(np.full(len(s), d, np.int64))
                    scheme.append(np.full(len(s), k, np.int64))
                    held += len(s)
                    notes.append((d, HELD + k, len(s), 0))
            if held > HOLD or len(notes) > HOLD:
                yield from flush()
        yield from flush()

    return run


def _pairs_within(order: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, scheme: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs inside each run (runs are short), with their scheme."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for n in np.unique(length[length > 1]).tolist():
        at = order[start[length == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        a, b = doc[at[:, i]].ravel(), doc[at[:, j]].ravel()
        parts.append((np.minimum(a, b), np.maximum(a, b), np.repeat(scheme[at[:, 0]], len(i))))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _count(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows and how often each occurs."""
    if not len(columns[0]):
        return (*columns, np.zeros(0, np.int64))
    order = np.lexsort(columns[::-1])
    c = [x[order] for x in columns]
    new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in c], axis=0)])
    return (*(x[new] for x in c), np.diff(np.r_[new, len(order)]))


def _meet(level: int, most: int):
    """Reducer: pairs that share a signature; for busy signatures only links to the first holder, and what they cost."""

    def reduce(columns, _) -> Iterator[pa.RecordBatch]:
        # equal signatures have equal low words: a bucket is worked off in parts
        parts = -(-len(columns[0]) // PART)
        for p in range(parts):
            own = np.flatnonzero(columns[0] % np.uint32(parts) == p)
            yield from part(*(c[own] for c in columns))

    def part(lo, hi, doc, scheme, mark) -> Iterator[pa.RecordBatch]:
        note = hi == 255
        if note.any():
            d, what, value, far = doc[note], scheme[note].astype(np.int64), lo[note].astype(np.int64), mark[note].astype(np.int64)
            size, twin, seg, less, met = what == 0, what == 1, (what >= HELD) & (what < LOST), (what >= LOST) & (what < MET), what >= MET
            yield from _rows(INFO, d[size], np.full(int(size.sum()), -1), value[size])
            yield from _rows(INFO, d[seg], what[seg] - HELD, value[seg])
            yield from _rows(DEAR, d[less], what[less] - LOST, value[less])
            other = (far << 32) | value
            yield from _rows(EQUAL, d[twin], other[twin], np.zeros(int(twin.sum()), np.int64))
            yield from _rows(STAR, other[met], d[met], what[met] - MET)
        i = np.flatnonzero(~note)
        if not len(i):
            return
        key = (hi[i].astype(np.uint64) << np.uint64(32)) | lo[i]
        d, k, m = doc[i], scheme[i].astype(np.int64), mark[i].astype(np.int64)
        order = np.lexsort((d, key))
        key_s, d_s = key[order], d[order]
        # a document once per signature
        fresh = np.r_[True, (key_s[1:] != key_s[:-1]) | (d_s[1:] != d_s[:-1])]
        once = order[fresh]
        start, length = runs_of(key[once])
        busy = length > most
        if level == 1:  # or busy in a task already
            busy |= np.logical_or.reduceat(m[once] > 0, start)
        a, b, q, n = _count(*_pairs_within(once, start[~busy], length[~busy], d, k))
        yield from _rows(PAIR, a, b, (q << 40) | n)
        if busy.any():
            first = np.repeat(d[once[start[busy]]], length[busy])
            member = d[once[np.concatenate([np.arange(s, s + n) for s, n in zip(start[busy].tolist(), length[busy].tolist(), strict=True)])]]
            a, b, n = _count(first[member != first], member[member != first])
            yield from _rows(STAR, a, b, n)
            dear = np.isin(key, key[once[start[busy]]])
            if level == 1:  # signatures lost, by document and scheme
                a, b, n = _count(d[dear], k[dear])
                yield from _rows(DEAR, a, b, n)
            else:  # marks of the signatures lost
                yield from _rows(DEAR, d[dear], k[dear], m[dear])

    return reduce


def _again(n_buckets: int):
    """Mapper: one-deletion neighbourhoods of the sets that lack segments, in the schemes where they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        notes: list[tuple[int, int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                yield from _deal_notes(notes, n_buckets)
                notes.clear()
                yield from _deal(*(np.concatenate(c) for c in zip(*parts, strict=True)), n_buckets)
                parts.clear()

        for b in batches:
            for d, raw, ks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(raw, "<u8")
                for k in ks:
                    s, mark, credit = neighbourhoods(x, k)
                    parts.append((s, np.full(len(s), d, np.int64), np.full(len(s), k, np.int64), mark))
                    notes.append((d, HELD + k, credit, 0))
                    held += len(s)
            if held > HOLD:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: the smallest elements of each set; linked sets share one of them."""
    for b in batches:
        docs, elements = [], []
        for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, "<u8")
            p = x[: len(x) - -(-3 * len(x) // 4) + 1]
            docs.append(np.full(len(p), d, np.int64))
            elements.append(p.astype(np.int64))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, elements)], names=["doc", "element"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for b in batches:
        a, c, x, y = (b.column(i).to_pylist() for i in range(4))
        good = []
        for i in range(len(a)):
            p, q = np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8")
            both = np.intersect1d(p, q, assume_unique=True).size
            good.append(100 * both >= 75 * (len(p) + len(q) - both))
        keep = np.flatnonzero(good)
        yield b.select(["a", "b"]).take(pa.array(keep))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose cell counts do not differ by more than links may: equal elements fall in equal cells."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32) for i in (2, 3))
        n = b.column(4).to_numpy() + b.column(5).to_numpy()
        keep = np.flatnonzero(7 * np.abs(x - y).sum(1) <= n)
        yield b.select(["a", "b"]).take(pa.array(keep))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are links.

    Sizes and cell counts are compared before whole sets travel, which sorts out most
    pairs that only share a passage, and no link.
    """
    a = sets.select(F.col("doc").alias("a"), F.col("cells").alias("x"), F.col("n").alias("na"))
    b = sets.select(F.col("doc").alias("b"), F.col("cells").alias("y"), F.col("n").alias("nb"))
    fit = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    fit = saved(fit.select("a", "b", "x", "y", "na", "nb").mapInArrow(lean(_close), "a long, b long"), "close")
    j = fit.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return j.select("a", "b", "x", "y").mapInArrow(lean(_linked), "a long, b long")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Words()
    for b in batches:
        x = [shingles(words_of(t), hashes).astype("<u8") for t in texts(b, "_text")]
        cells = [np.minimum(np.bincount((_mix(s) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for s in x]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in x], pa.int64()), pa.array(cells, pa.binary()), pa.array([s.tobytes() for s in x], pa.binary())], names=["doc", "n", "cells", "set"])


def _band(n):
    """Column: band of a size."""
    return (F.array_position(F.transform(F.array(*[F.lit(top(k)) for k in range(64)]), lambda t: t >= n), True) - 1).cast("long")


def _need():
    """Column: segments that a set of n elements needs in scheme b; may_differ and one more."""
    tops = F.array(*[F.lit(top(k)) for k in range(64)])
    return F.when(F.col("b") == _band(F.col("n")), F.expr("(n + 4 * n div 3) div 7 + 1")).otherwise(F.floor((F.col("n") + F.least(F.col("n"), F.element_at(tops, (F.col("b") + 1).cast("int")))) / 7) + 1)


def _likely(rows: DataFrame, usable: DataFrame, weight: int) -> DataFrame:
    """(a, b) of the pairs that share as many signatures as links must.

    ``usable`` holds (doc, scheme, n, usable): at most (na + nb) // 7 of the segments that
    count for a set can differ, the others are equal in a link (or, with ``weight`` 2,
    near enough), and each of those is a signature shared.
    """
    p = rows.where(F.col("kind") == PAIR).select("a", "b", F.shiftright("c", 40).alias("scheme"), F.expr("c & 1099511627775L").alias("shared"))
    p = p.groupBy("a", "b", "scheme").agg(F.sum("shared").alias("shared"))
    side = lambda x: usable.select(F.col("doc").alias(x), "scheme", F.col("n").alias(f"n{x}"), F.col("usable").alias(f"u{x}"))
    j = p.join(side("a"), ["a", "scheme"]).join(side("b"), ["b", "scheme"])
    j = j.where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (F.col("scheme") == _band(F.least("na", "nb"))))
    return j.where(weight * F.col("shared") >= F.greatest("ua", "ub") - F.floor((F.col("na") + F.col("nb")) / 7)).select("a", "b")


def links(d: DataFrame, busy: int = BUSY) -> tuple[DataFrame, DataFrame]:
    """(sizes, components) of ``d`` (doc, _text), where doc is unique: (doc, n), and (doc, component) of those with links."""
    n = packed.n_buckets(d)
    rows = saved(packed.through(d.mapInArrow(lean(_signed(n, busy)), packed.ROWS), n, _SIGNED, _meet(1, busy), ROWS), "join1")
    sizes = rows.where((F.col("kind") == INFO) & (F.col("b") == -1)).select(F.col("a").alias("doc"), F.col("c").alias("n"))
    equal = rows.where(F.col("kind") == EQUAL).select("a", "b")
    # what each set holds in each scheme, less what is too dear
    lost = rows.where(F.col("kind") == DEAR).groupBy("a", "b").agg(F.sum("c").alias("lost"))
    held = rows.where((F.col("kind") == INFO) & (F.col("b") >= 0)).select("a", "b", F.col("c").alias("held"))
    usable = held.join(lost, ["a", "b"], "left").join(sizes.select(F.col("doc").alias("a"), "n"), "a")
    usable = saved(usable.select("a", "b", "n", (F.col("held") - F.coalesce("lost", F.lit(0))).alias("usable")), "usable")
    short = saved(usable.where(F.col("usable") < _need()).select("a", "b", "n"), "short")
    pairs = _likely(rows, usable.select(F.col("a").alias("doc"), F.col("b").alias("scheme"), "n", "usable"), 1)
    stars = rows.where(F.col("kind") == STAR).groupBy("a", "b").agg(F.sum("c").alias("s")).where(F.col("s") >= SUPPORT).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = stars.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    stars = stars.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")).select("a", "b")
    first = saved(pairs.unionByName(stars).distinct(), "pairs")
    wanted = first.select(F.col("a").alias("doc")).unionByName(first.select(F.col("b").alias("doc"))).unionByName(short.select(F.col("a").alias("doc"))).distinct()
    sets = saved(d.join(wanted.hint("merge"), "doc", "left_semi").select("doc", "_text").mapInArrow(lean(_set_rows), "doc long, n long, cells binary, set binary"), "sets")

    # one-deletion neighbourhoods
    by_doc = short.groupBy(F.col("a").alias("doc")).agg(F.collect_list("b").alias("ks"))
    near = sets.join(by_doc.hint("merge"), "doc").select("doc", "set", "ks").mapInArrow(lean(_again(n)), packed.ROWS)
    rows2 = saved(packed.through(near, n, _SIGNED, _meet(2, busy), ROWS), "join2")
    # a segment whose whole is lost gives nothing; one that loses a neighbour counts once
    lost2 = rows2.where(F.col("kind") == DEAR).groupBy("a", "b", F.expr("c div 4").alias("segment")).agg(F.max(F.expr("CASE WHEN c % 2 = 1 THEN 1 + c % 4 div 2 ELSE 1 END")).alias("lost")).groupBy("a", "b").agg(F.sum("lost").alias("lost"))
    credit = rows2.where((F.col("kind") == INFO) & (F.col("b") >= 0)).select("a", "b", F.col("c").alias("credit"))
    credit = short.join(credit, ["a", "b"]).join(lost2, ["a", "b"], "left")
    credit = saved(credit.select("a", "b", "n", (F.col("credit") - F.coalesce("lost", F.lit(0))).alias("usable")), "credit")
    pairs2 = _likely(rows2, credit.select(F.col("a").alias("doc"), F.col("b").alias("scheme"), "n", "usable"), 2)

    found = saved(verify(first.unionByName(pairs2).distinct(), sets), "links")
    comp = components(found.unionByName(equal))

    credit = credit.where(F.col("usable") < _need())
    rest = credit.select(F.col("a").alias("doc")).distinct()
    more = _leftover_links(sets.join(rest.hint("merge"), "doc", "left_semi"), comp)
    if not more.isEmpty():
        comp = components(found.unionByName(equal).unionByName(more))
    return sizes, comp


def _leftover_links(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): the links between different components of the sets that are left.

    Linked sets share one of their smallest elements, and so meet at that element's first
    holder; sets are gathered by such holders. A holder's sets are compared in blocks of
    ``LEFT_BLOCK``: each pair of blocks is a task's work of bounded size, which counts
    common elements by a matrix product and gives out links only.
    """
    p = sets.select("doc", "set").mapInArrow(lean(_prefixes), "doc long, element long")
    p = saved(p.join(comp, "doc", "left").select("doc", "element", F.coalesce("component", "doc").alias("component")), "prefixes")
    holder = p.groupBy("element").agg(F.min("doc").alias("holder"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("element", "holder")
    met = p.join(holder, "element").select("holder", "doc", "component").distinct()
    n = met.groupBy("holder").agg(F.ceil(F.count("*") / LEFT_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    cells = met.join(n, "holder").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("holder", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "component")
    cells = cells.join(sets.select("doc", "set").hint("merge"), "doc").repartition("holder", "i", "j").sortWithinPartitions("holder", "i", "j", "own")
    return saved(cells.select("holder", "i", "j", "own", "doc", "component", "set").mapInArrow(lean(_compared), "a long, b long"), "links")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each pair of blocks; rows come sorted by pair of blocks."""
    key, held = None, []

    def compare() -> Iterator[pa.RecordBatch]:
        if len({r[1] for r in held}) < 2:
            return
        i, j = key[1:]
        left = [r for r in held if r[0] == i]
        right = [r for r in held if r[0] == j]
        a, b = _links_between(left, right)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        for h, i, j, own, doc, component, raw in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (h, i, j) != key:
                if held:
                    yield from compare()
                key, held = (h, i, j), []
            held.append((own, component, doc, raw))
    if held:
        yield from compare()


def _links_between(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components, from (block, component, doc, set) rows: as many as connect what all links between them connect."""
    sides = []
    for rows in (left, right):
        each = [np.frombuffer(r[3], "<u8") for r in rows]
        sides.append((np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([len(x) for x in each], np.int64), np.concatenate(each) if each else np.zeros(0, np.uint64)))
    (da, ca, na, xa), (db, cb, nb, xb) = sides
    both = np.intersect1d(xa, xb)  # elements on one side only are common to no pair
    shared = np.zeros((len(da), len(db)), np.float32)

    def common_ones(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, place in ``both``) of the elements that are there, in 32 bits."""
        i = np.flatnonzero(np.isin(x, both))
        return np.repeat(np.arange(len(n), dtype=np.int32), n)[i], np.searchsorted(both, x[i]).astype(np.int32)

    (row_a, at_a), (row_b, at_b) = common_ones(xa, na), common_ones(xb, nb)
    del xa, xb, sides
    for lo in range(0, len(both), SLICE):  # elements a slice at a time: bounded memory
        p, q = (at_a >= lo) & (at_a < lo + SLICE), (at_b >= lo) & (at_b < lo + SLICE)
        width = min(SLICE, len(both) - lo)
        m, k = np.zeros((len(da), width), np.float32), np.zeros((len(db), width), np.float32)
        m[row_a[p], at_a[p] - lo] = 1
        k[row_b[q], at_b[q] - lo] = 1
        shared += m @ k.T
    common = shared.astype(np.int64)
    i, j = np.nonzero((100 * common >= 75 * (na[:, None] + nb[None] - common)) & (ca[:, None] != cb[None]))
    kept = forest(ca[i], cb[j])
    return da[i[kept]], db[j[kept]]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links (a, b) that connect what all of them connect, without a cycle: no more than there are nodes."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    tree, chosen, live = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        x, y = tree[u[live]], tree[v[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return np.sort(np.concatenate(chosen)) if chosen else live
        # each tree takes its first link out of it; places are a total order, so this makes no cycle
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        picked = np.unique(first[first < len(a)])
        chosen.append(picked)
        root = np.arange(len(nodes))
        for p, q in zip(tree[u[picked]].tolist(), tree[v[picked]].tolist(), strict=True):
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            root[max(p, q)] = min(p, q)
        while (root[root] != root).any():
            root = root[root]
        tree = root[tree]


def _rows_of(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("_text"))


def _simple(d: DataFrame) -> bool:
    """Whether each row has a doc_id of its own."""
    return d.groupBy("doc").count().where((F.col("count") > 1) | F.col("doc").isNull()).isEmpty()


def _digest():
    return F.sha2(F.coalesce("_text", F.lit("")), 256)


def _classes(d: DataFrame, busy: int) -> DataFrame:
    """(doc, digest, n, class, component_id) of each distinct text of each doc_id; only equal rows share a number."""
    rows = d.where(F.col("doc").isNotNull()).withColumn("digest", _digest()).groupBy("doc", "digest").agg(F.first("_text").alias("_text"))
    rows = saved(rows.withColumn("node", F.monotonically_increasing_id()), "documents")
    sizes, comp = links(rows.select(F.col("node").alias("doc"), "_text"), busy)
    named = rows.select("doc", "digest", "node").join(sizes.select(F.col("doc").alias("node"), "n"), "node")
    named = named.join(comp.select(F.col("doc").alias("node"), "component"), "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = named.groupBy("class").agg(F.min("doc").alias("component_id"))
    return saved(named.select("doc", "digest", "n", "class").join(least, "class"), "classes")


def ngram_join(docs: DataFrame, busy: int = BUSY) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Null or empty text has an empty set and no links. Rows with one doc_id are one
    document if their texts are equal; with different texts they are documents of their
    own, each with its links, that have the name in common. A null doc_id has no links.
    Other columns are ignored. No rows give none.
    """
    d = _rows_of(docs)
    if _simple(d):
        sizes, comp = links(d, busy)
        return sizes.join(comp, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    known = d.where(F.col("doc").isNotNull()).select("doc", _digest().alias("digest")).join(_classes(d, busy), ["doc", "digest"])
    nameless = d.where(F.col("doc").isNull()).mapInArrow(lean(_sizes), "doc long, n long")
    none = F.lit(None).cast("long")
    return known.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(nameless.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Words()
    for b in batches:
        n = [len(shingles(words_of(t), hashes)) for t in texts(b, "_text")]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc", "n"])


def keep_one(docs: DataFrame, busy: int = BUSY) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: that of the smallest doc_id (then the smallest digest of its text).

    Different texts under one doc_id are different documents. Of rows equal in doc_id and
    text one stays, whatever their other columns hold. Rows without a doc_id all stay, as
    does each text without words.
    """
    d = _rows_of(docs)
    own = F.col("doc_id").cast("long")
    if _simple(d):
        sizes, comp = links(d, busy)
        others = saved(comp.where("doc <> component").select(F.col("doc").alias("_nj_gone")), "gone")
        return docs.join(others.hint("merge"), own == F.col("_nj_gone"), "left_anti")
    first = _classes(d, busy).groupBy("class").agg(F.min(F.struct("doc", "digest")).alias("x")).select(F.col("x.doc").alias("_nj_doc"), F.col("x.digest").alias("_nj_kept"))
    first = saved(first, "kept")
    inner = docs.where(own.isNotNull()).withColumn("_nj_digest", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    once = inner.join(first.hint("merge"), (own == F.col("_nj_doc")) & (F.col("_nj_digest") == F.col("_nj_kept")), "left_semi").dropDuplicates(["doc_id", "_nj_digest"]).drop("_nj_digest")
    return once.unionByName(docs.where(own.isNull()))
