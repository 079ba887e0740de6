"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of some megabytes. A shard's words become ids of the
benchmark's vocabulary, 0 for any other word and between documents, and its suffix array
orders every suffix that begins in a run of enough benchmark words, over the run's whole
length, by prefix doubling; no match begins elsewhere. The windows that the benchmark's
suffixes begin with are looked up by binary search, narrowed word by word; the range left
gives all their places. Matches on one diagonal join into the longest verbatim matches.

A benchmark travels to the executors in blocks of at most ``block_words`` words (one
item, if it is longer), one after another; a row carries what earlier blocks found.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, merge_spans, small_batches, texts

#: Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: everything else becomes a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class SuffixArray:
    """The suffixes of ``ids`` that begin in runs (of ids other than 0) of ``shortest`` words or more, in order; a suffix ends with its run."""

    def __init__(self, ids: np.ndarray, shortest: int):
        n = len(ids)
        stops = np.r_[np.flatnonzero(ids == 0), n]
        length = np.diff(np.r_[-1, stops]) - 1  # of the run before each stop
        room = np.repeat(stops, length + 1)[:n] - np.arange(n)
        at = np.flatnonzero((ids != 0) & (np.repeat(length, length + 1)[:n] >= shortest))
        self.ids = np.r_[ids, np.zeros(1, ids.dtype)].astype(np.int64)
        rank = np.zeros(n + 1, np.int64)
        rank[at] = ids[at]
        left, k = at, 1  # places whose rank is shared
        most = int(room[at].max()) if len(at) else 0
        while k < most and len(left):
            behind = np.where(room[left] > k, rank[np.minimum(left + k, n)], 0)
            order = np.lexsort((behind, rank[left]))
            own, behind, place = rank[left][order], behind[order], left[order]
            new = np.r_[True, (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])]
            first = np.flatnonzero(new)
            # ranks keep their order if they count the suffixes that come before: those of lower rank, then of this one
            if k == 1:
                start = np.arange(len(own))
                base = start[np.r_[True, own[1:] != own[:-1]]][np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1]
            else:
                base = own - 1
            group = np.r_[True, own[1:] != own[:-1]]
            begin = np.flatnonzero(group)[np.cumsum(group) - 1]
            inside = first[np.cumsum(new) - 1] - begin
            rank[place] = base + inside + 1
            size = np.diff(np.r_[first, len(place)])
            left = np.sort(place[np.repeat(size > 1, size)])
            k *= 2
        self.array = at[np.argsort(rank[at], kind="stable")]

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges, whose suffixes share ``depth`` words, that go on with ``word``."""
        end = len(self.ids) - 1
        out = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                w = self.ids[np.minimum(self.array[mid] + depth, end)]
                low = w <= word[open_] if right else w < word[open_]
                a[open_[low]] = mid[low] + 1
                b[open_[~low]] = mid[~low]
            out.append(a)
        return out[0], out[1]


class Probe:
    """The windows of some benchmark items, ready for look-up in a shard's suffix array."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.shortest = width
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            w = min(width, len(ids))
            self.shortest = min(self.shortest, w)
            for j in range(len(ids) - w + 1):
                places.setdefault(tuple(ids[j : j + w]), []).append((len(self.names), j))
            self.names.append(name)
        self.places = list(places.values())
        self.length = np.array([len(t) for t in places], np.int64)
        self.words = np.zeros((len(places), width), np.int64)
        for k, t in enumerate(places):
            self.words[k, : len(t)] = t

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence in ``ids``, which holds 0 where no match can go on."""
        shard = SuffixArray(ids, self.shortest)
        window = np.arange(len(self.places))
        lo, hi = np.zeros(len(window), np.int64), np.full(len(window), len(shard.array), np.int64)
        for depth in range(self.words.shape[1]):
            on = np.flatnonzero((lo < hi) & (self.length > depth))
            if not len(on):
                break
            lo[on], hi[on] = shard.narrowed(lo[on], hi[on], depth, self.words[on, depth])
        count = hi - lo
        first = np.repeat(lo - (np.cumsum(count) - count), count)
        return np.repeat(window, count), shard.array[first + np.arange(int(count.sum()))]


def _shard(probe: Probe, batch_texts: list[str]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Word counts, and per document its (window, place) matches."""
    get, zero = probe.vocabulary.get, itertools.repeat(0)
    parts, sizes = [], []
    gap = np.zeros(1, np.uint32)
    for t in batch_texts:
        w = words_of(t)
        parts += [np.fromiter(map(get, w, zero), np.uint32, len(w)), gap]
        sizes.append(len(w))
    ids = np.concatenate(parts) if parts else gap
    window, place = probe.find(ids)
    starts = np.cumsum([0, *[s + 1 for s in sizes]])
    order = np.argsort(place, kind="stable")
    window, place = window[order], place[order]
    cut = np.searchsorted(place, starts)
    return sizes, [(window[cut[k] : cut[k + 1]], place[cut[k] : cut[k + 1]] - starts[k]) for k in range(len(sizes))]


def _union(probe: Probe, window: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    return merge_spans(list(zip(place.tolist(), (place + probe.length[window]).tolist(), strict=True))) if len(window) else []


def _items(probe: Probe, window: np.ndarray) -> set[str]:
    return {probe.names[i] for k in set(window.tolist()) for i, _ in probe.places[k] if probe.names[i] is not None}


def longest(probe: Probe, window: np.ndarray, place: np.ndarray) -> list[tuple[str | None, int, int, int]]:
    """(item, place in the item, place in the document, words) of each longest verbatim match."""
    on: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, p in zip(window.tolist(), place.tolist(), strict=True):
        for i, j in probe.places[k]:
            on.setdefault((i, p - j), []).append((p, p + int(probe.length[k])))
    out = []
    for (i, d), spans in on.items():
        reach: list[list[int]] = []
        for s, e in sorted(spans):
            if reach and s <= reach[-1][0] + reach[-1][2]:  # the next window of the same run
                reach[-1][1], reach[-1][2] = max(reach[-1][1], e), s - reach[-1][0] + 1
            else:
                reach.append([s, e, 1])
        out += [(probe.names[i], s - d, s, e - s) for s, e, _ in reach]
    return sorted(out, key=lambda m: (m[2], m[1], str(m[0])))


def blocks_of(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Probe]:
    """The benchmark's probes, one at a time."""
    n_words = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = b.agg(F.sum(n_words)).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Probe([(r["item_id"], r["text"]) for r in part.orderBy("item_id").toLocalIterator()], width)


#: Bytes of text in a shard (one batch, if it has more).
SHARD = 8 << 20
_OUT = "n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>, longest bigint"
_ARROW = [pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string()), pa.int64()]
_NEW = ["n_words", "spans", "items", "longest"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SHARD:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(docs: DataFrame, keep: list[str], benchmark: DataFrame, width: int, block_words: int) -> DataFrame:
    """``keep`` and, per row: words, hit word spans, items whose windows occur, words of the longest match."""
    small_batches(docs.sparkSession)
    d = docs.select(*keep, "_text")
    schema = StructType([*d.schema.fields, *StructType.fromDDL(_OUT).fields])

    def scanner(sent, again: bool):
        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for shard in _shards(batches):
                each = [texts(b, "_text") for b in shard]
                sizes, found = _shard(p, list(itertools.chain(*each)))
                at = 0
                for b, t in zip(shard, each, strict=True):
                    n, own = sizes[at : at + len(t)], found[at : at + len(t)]
                    at += len(t)
                    spans = [_union(p, w, x) for w, x in own]
                    items = [_items(p, w) for w, _ in own]
                    most = [max((m[3] for m in longest(p, w, x)), default=0) if len(w) else 0 for w, x in own]
                    if again:
                        before = [b.column(len(keep) + 2 + k).to_pylist() for k in range(3)]
                        spans = [merge_spans([*((x["s"], x["e"]) for x in old), *new]) for old, new in zip(before[0], spans, strict=True)]
                        items = [new.union(old) for old, new in zip(before[1], items, strict=True)]
                        most = list(map(max, before[2], most))
                    new = [n, [[{"s": x, "e": y} for x, y in s] for s in spans], [sorted(i) for i in items], most]
                    yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep) + 1)), *(pa.array(x, y) for x, y in zip(new, _ARROW, strict=True))], names=[*keep, "_text", *_NEW])

        return scanned

    again = False
    for probe in blocks_of(benchmark, width, block_words):
        d = d.mapInArrow(lean(scanner(docs.sparkSession.sparkContext.broadcast(probe), again)), schema)
        again = True
    return d.drop("_text")


def decontamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim match), spans (hit word ranges), items.

    Null or empty text has no words and is clean; an item without words is never found,
    one of fewer than ``width`` words is one window; a null item_id hits but is not listed;
    equal rows stay; other columns are ignored. No rows give none, no benchmark finds nothing.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    m = _scan(d, ["doc_id"], benchmark, width, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest", "spans", "items")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, item_start, doc_start, n_words): the longest verbatim matches and where they are."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    out = None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
    for probe in blocks_of(benchmark, width, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(probe)

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for shard in _shards(batches):
                _, each = _shard(p, [t for b in shard for t in texts(b, "_text")])
                rows = [(doc, *m) for doc, (w, at) in zip([x for b in shard for x in b.column(0).to_pylist()], each, strict=True) if len(w) for m in longest(p, w, at)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        one = d.mapInArrow(lean(found), "doc_id bigint, item_id string, item_start bigint, doc_start bigint, n_words bigint")
        out = one if out is None else out.unionByName(one)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that no benchmark window hits, with their columns."""
    names = [f"_in{k}" for k in range(len(docs.columns))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").cast("string").alias("_text"))
    m = _scan(d, names, benchmark, width, block_words)
    return m.where(F.size("spans") == 0).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
