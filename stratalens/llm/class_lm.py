"""Brown class-based bigrams: exchange clustering, class transitions, word emissions.

Every word that the training texts hold ``floor`` times or more gets a class, in two
blocks. The *core*, the most frequent words, is clustered by rounds of exchange: each
word is tried in every class against the class bigram counts, in parallel, as in
distributed exchange clustering; the moves that raise the likelihood most are made
together, and if the likelihood of the whole falls, fewer of them are. Every other word
then makes one exchange step against the core's counts, which stand still: it goes to
the class that its own neighbours' classes raise the likelihood most in, to first order.
So the words with classes grow with the corpus; only the core is bounded. Rarer and
unknown words form a class, and the end of a text, which also precedes its first word,
is one.

    log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class)

Transitions are counted over the classes of all words and back off to class
frequencies; emissions are relative frequencies, among the rare words with 0.5 added to
each count and to the unknown word.

The most frequent words, at most ``max_known``, travel to the executors, where texts
become numbers once. The other words are joined: none of them has enough rows to make a
hot key. What travels makes no difference to the scores.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import forget, lean, runs_of, saved, shared_dir, small_batches, texts, words_of

#: Distinct words or pairs that a task holds before it passes their counts on.
FLUSH = 400_000
BACKOFF = 5.0
END = b""  # no word is empty


def held_out_column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): every word of ``_text``, and one end for each row."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
                c.clear()

        for b in batches:
            for t in texts(b, "_text"):
                c.update(words_of(t))
                c[END] += 1
            if len(c) > FLUSH:
                yield from out()
        yield from out()

    return docs.select("_text").mapInArrow(lean(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The words that travel, by falling count (then by word); the first ``clustered`` are the core.

    Units of the exchange: the words of the core, all others, the end.
    """

    words: list[bytes]
    counts: np.ndarray
    clustered: int
    total: int
    types: int
    end: int
    rare_types: int
    floor: int

    def __post_init__(self):
        self.other, self.end_unit, self.units = self.clustered, self.clustered + 1, self.clustered + 2


def _bin(n):
    """Column: a number that does not fall with n; there are some thousands of them, however large n."""
    return F.when(n < 1024, n).otherwise((F.floor(F.log2(n.cast("double")) * 64) + 384).cast("long"))


def vocabulary(counts: DataFrame, max_known: int, core: int, floor: int) -> Vocabulary:
    t = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.length("word") == 0, F.col("n"))).alias("end"), F.count(F.when(F.col("n") < floor, 1)).alias("rare")).first()
    words = counts.where((F.length("word") > 0) & (F.col("n") >= floor))
    least, room = None, max_known
    for r in sorted(words.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["bin"]):
        if r["k"] > room:
            break
        least, room = r["bin"], room - r["k"]
    # at most max_known rows
    top = [] if least is None else sorted((-r["n"], bytes(r["word"])) for r in words.where(_bin(F.col("n")) >= least).toLocalIterator())
    n = np.array([-x for x, _ in top], np.int64)
    end = t["end"] or 0
    return Vocabulary([w for _, w in top], n, min(core, len(top)), t["n"] or 0, t["v"], end, t["rare"] - (0 < end < floor), floor)


_TEXT = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("rare", pa.list_(pa.binary()))])


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(uid, doc_id, held_out, ids, rare) of each row: word numbers as 32-bit integers, and the words that have none (their number is that of words)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value.words
        get, none = {w: k for k, w in enumerate(words)}.get, itertools.repeat(len(words))
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, rare = [], []
            for t in texts(b, "_text"):
                w = words_of(t)
                x = np.fromiter(map(get, w, none), np.uint32, len(w))
                ids.append(x.tobytes())
                rare.append([w[i] for i in np.flatnonzero(x == len(words)).tolist()])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], schema=_TEXT)
            uid += n

    return docs.select("doc_id", "held_out", "_text").mapInArrow(lean(encoded), "uid long, doc_id long, held_out boolean, ids binary, rare array<binary>")


class _Tally:
    """Counts of codes, folded now and then."""

    def __init__(self):
        self.codes, self.n, self.held, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> bool:
        """Whether it is time to fold."""
        self.held.append(codes)
        self.waiting += len(codes)
        return self.waiting > 2_000_000

    def fold(self) -> int:
        key, each = np.unique(np.concatenate(self.held), return_counts=True) if self.held else (self.codes[:0], self.n[:0])
        key, each = np.r_[self.codes, key], np.r_[self.n, each]
        order = np.argsort(key, kind="stable")
        start, _ = runs_of(key[order])
        self.codes, self.n = key[order][start], np.add.reduceat(each[order], start) if len(start) else each
        self.held, self.waiting = [], 0
        return len(self.codes)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.codes, self.n
        self.codes, self.n = self.codes[:0], self.n[:0]
        return out


@dataclass
class _Flat:
    """The word numbers of a batch's texts, one text behind another: number and text of each, and its place in a row of all where an end stands before each text and behind the last."""

    ids: np.ndarray
    row: np.ndarray
    at: np.ndarray
    rows: int

    @staticmethod
    def of(column: pa.Array) -> _Flat:
        size = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)) // 4
        ids = np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        return _Flat(ids, row, np.arange(len(ids)) + row + 1, len(size))

    def spread(self, values: np.ndarray, end: int) -> np.ndarray:
        out = np.full(len(self.ids) + self.rows + 1, end, np.int64)
        out[self.at] = values
        return out


def count_pairs(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """(a, b, n): neighbouring units; the end stands before each first word and after each last one."""
    core, end, units = v.clustered, v.end_unit, v.units

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def out() -> Iterator[pa.RecordBatch]:
            codes, n = tally.take()
            for k in range(0, len(codes), 1 << 16):
                c = codes[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((c // units).astype(np.int32)), pa.array((c % units).astype(np.int32)), pa.array(n[k : k + (1 << 16)])], names=["a", "b", "n"])

        for b in batches:
            t = _Flat.of(b.column(0))
            u = t.spread(np.minimum(t.ids, core), end)
            if t.rows and tally.add(u[:-1] * units + u[1:]) and tally.fold() > 4 * FLUSH:
                yield from out()
        tally.fold()
        yield from out()

    return encoded.select("ids").mapInArrow(lean(counted), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of matrices that come as packed (a, row) rows; each row is added up in one task, a part after another."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for a, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(row, "<i8")
                total[a] = total[a] + x if a in total else x
        yield from _matrix_rows(total)

    m = np.zeros((size, size))
    for a, row in parts.repartition("a").mapInArrow(lean(summed), "a int, row binary").collect():  # size rows
        m[a] = np.frombuffer(row, "<i8")
    return m


def _matrix_rows(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in rows.values()], pa.binary())], names=["a", "row"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """The class bigram log-likelihood, up to what no move changes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def best_move(m: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, loop: float, k: int) -> tuple[int, float]:
    """The class among the first ``k`` that a word of class ``own`` is best moved to, and what is gained.

    right, left: its counts with following and preceding classes, without those with
    itself; loop: those.
    """
    base = m.astype(np.float64)
    base[own] -= right
    base[:, own] -= left
    base[own, own] -= loop
    rows, cols = base.sum(1) + left, base.sum(0) + right  # its neighbours keep their places wherever it goes
    fb = _f(base)
    row = _f(base[:k] + right).sum(1) - fb[:k].sum(1)
    col = (_f(base[:, :k] + left[:, None]) - fb[:, :k]).sum(0)
    d = np.arange(k)
    self_now = base[d, d]
    # the cell of the class with itself was counted in both sums
    cell = _f(self_now + right[:k] + left[:k] + loop) - _f(self_now + right[:k]) - _f(self_now + left[:k]) + _f(self_now)
    out, into = right.sum() + loop, left.sum() + loop
    gain = row + col + cell - (_f(rows[:k] + out) - _f(rows[:k])) - (_f(cols[:k] + into) - _f(cols[:k]))
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def exchange(pairs: DataFrame, v: Vocabulary, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts). Words outside the core and the end keep classes of their own."""
    spark = pairs.sparkSession
    fixed = v.units - v.clustered
    k = min(classes, max(v.clustered, 1))
    size = k + fixed
    of = np.r_[np.arange(v.clustered) % k, k + np.arange(fixed)]
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("x"), F.lit(True).alias("right"), "n").unionByName(pairs.where(F.col("b") < v.clustered).select(F.col("b").alias("w"), F.col("a").alias("x"), F.lit(False).alias("right"), "n"))
    # all rows of a word in one partition; a word has at most two rows for each unit
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    table = both.repartition("w").sortWithinPartitions("w").checkpoint()

    def matrix(of: np.ndarray) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros(size * size)
            for b in batches:
                w, x, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                m += np.bincount(of[w] * size + of[x], n, size * size)
            m = m.reshape(size, size)
            yield from _matrix_rows({a: m[a] for a in np.flatnonzero(m.any(1)).tolist()})

        return added_up(table.where("right").select("w", "x", "n").mapInArrow(lean(summed), "a int, row binary"), size)

    def moves(of: np.ndarray, m: np.ndarray) -> list[tuple[float, int, int]]:
        clustered = v.clustered

        def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches]
            if not parts:
                return
            w, x, r, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            keep = w < clustered
            w, x, r, n = w[keep], x[keep], r[keep], n[keep]
            order = np.argsort(w, kind="stable")
            w, x, r, n = w[order], x[order], r[order], n[order]
            rows = []
            for s, length in zip(*runs_of(w), strict=True):
                i = slice(s, s + length)
                loop = float(n[i][r[i] & (x[i] == w[s])].sum())
                other = x[i] != w[s]
                right = np.bincount(of[x[i]][other & r[i]], n[i][other & r[i]], size)
                left = np.bincount(of[x[i]][other & ~r[i]], n[i][other & ~r[i]], size)
                to, gain = best_move(m, int(of[w[s]]), right, left, loop, k)
                if gain > 1e-6 and to != of[w[s]]:
                    rows.append((gain, int(w[s]), to))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["gain", "w", "to"])

        return sorted(tuple(r) for r in table.mapInArrow(lean(tried), "gain double, w long, to long").collect())[::-1]  # at most as many rows as the core has words

    m = matrix(of)
    share = 0.5
    for _ in range(rounds if v.clustered > 1 else 0):
        found = moves(of, m)
        if not found:
            break
        for _ in range(4):
            new = of.copy()
            for _, w, to in found[: max(1, int(len(found) * share))]:
                new[w] = to
            now = matrix(new)
            if likelihood(now) > likelihood(m):
                of, m = new, now
                break
            share /= 4
        else:
            break
    return of, m


def attraction(m: np.ndarray, k: int) -> np.ndarray:
    """What a word gains in each of the first ``k`` classes, to first order, by a preceding (first rows) or following (last rows) class."""
    soft = np.log(m + 0.5)
    out, into = np.log(m.sum(1) + 0.5), np.log(m.sum(0) + 0.5)
    return np.r_[soft[:, :k] - into[:k], soft[:k].T - out[:k]]


def assigned(contexts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The best class for each row of context counts."""
    return np.argmax(np.round(contexts @ gains, 6), axis=1)


def _codes(t: _Flat, of: np.ndarray, core: int, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes before some words of a batch and, ``size`` higher, those behind; ``of`` holds the units' classes."""
    c = t.spread(of[np.minimum(t.ids, core)], of[core + 1])
    return c[t.at[at] - 1], c[t.at[at] + 1] + size


def classes_of_known(train: DataFrame, v: Vocabulary, of: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """The classes of the words that travel."""
    core, size, n_words = v.clustered, m.shape[0], len(v.words)
    gains, n_buckets = attraction(m, k), packed.n_buckets(train)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def out() -> Iterator[pa.RecordBatch]:
            codes, n = tally.take()
            word, code = codes // (2 * size), codes % (2 * size)
            yield from packed.deal(word % n_buckets, [word.astype("<u4"), code.astype("<u2"), n])

        for b in batches:
            t = _Flat.of(b.column(0))
            at = np.flatnonzero((t.ids >= core) & (t.ids < n_words))
            if len(at):
                left, right = _codes(t, of, core, size, at)
                x = t.ids[at] * 2 * size
                if tally.add(np.r_[x + left, x + right]) and tally.fold() > 4 * FLUSH:
                    yield from out()
        tally.fold()
        yield from out()

    def reduce(columns, _) -> Iterator[pa.RecordBatch]:
        word, code, n = columns
        names, row = np.unique(word, return_inverse=True)
        for lo in range(0, len(names), 4096):  # bounded memory
            i = (row >= lo) & (row < lo + 4096)
            own = names[lo : lo + 4096]
            seen = np.bincount((row[i] - lo) * 2 * size + code[i], n[i], len(own) * 2 * size).reshape(len(own), 2 * size)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(assigned(seen, gains).astype(np.int32))], names=["word", "class"])

    cls = np.zeros(n_words, np.int64)
    cls[:core] = of[:core]
    found = packed.through(train.select("ids").mapInArrow(lean(dealt), packed.ROWS), n_buckets, ["<u4", "<u2", "<i8"], reduce, "word long, class int")
    for w, c in found.toLocalIterator():  # at most max_known rows
        cls[w] = c
    return cls


def classes_of_rare(train: DataFrame, v: Vocabulary, of: np.ndarray, m: np.ndarray, k: int) -> DataFrame:
    """(word, n, class) of the other words of the training texts; those below the floor have the class behind all, ``k``."""
    core, size, none, floor = v.clustered, m.shape[0], len(v.words), v.floor
    gains = attraction(m, k)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "codes": pa.array([np.array(x, "<u2").tobytes() for x in c.values()], pa.binary())})
            c.clear()
            return b

        held = 0
        for b in batches:
            t = _Flat.of(b.column(0))
            left, right = _codes(t, of, core, size, np.flatnonzero(t.ids == none))
            held += len(left)
            for w, p, q in zip(b.column(1).flatten().to_pylist(), left.tolist(), right.tolist(), strict=True):
                c.setdefault(w, []).extend((p, q))
            if held > FLUSH:
                yield out()
                held = 0
        yield out()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(b"".join(x), "<u2") for x in b.column(1).to_pylist()]
            n = np.array([len(p) // 2 for p in parts], np.int64)
            row = np.repeat(np.arange(len(parts)), 2 * n)
            flat = np.concatenate(parts).astype(np.int64) if parts else row
            contexts = np.bincount(row * 2 * size + flat, minlength=len(parts) * 2 * size).reshape(len(parts), 2 * size).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.where(n < floor, k, assigned(contexts, gains)).astype(np.int32))], names=["word", "n", "class"])

    # a word has no more occurrences than words that do not travel may have
    found = train.select("ids", "rare").mapInArrow(lean(seen), "word binary, codes binary").groupBy("word").agg(F.collect_list("codes").alias("codes"))
    return found.mapInArrow(lean(judged), "word binary, n long, class int")


def sequences(encoded: DataFrame, rare: DataFrame) -> DataFrame:
    """``encoded`` with the classes and counts of its other words, in order: uid, doc_id, held_out, ids, more."""
    words = encoded.where(F.size("rare") > 0).select("uid", F.posexplode("rare").alias("k", "word"))
    found = words.join(rare, "word").groupBy("uid").agg(F.collect_list(F.struct("k", "class", "n")).alias("more"))
    none = F.array().cast("array<struct<k:int,class:int,n:bigint>>")
    return encoded.drop("rare").join(found, "uid", "left").withColumn("more", F.coalesce("more", none))


@dataclass
class Model:
    """Classes: k of words, one of rare and unknown words, one of the end."""

    k: int
    cls: np.ndarray
    counts: np.ndarray
    total: int
    types: int
    rare_types: int
    end: int
    log_move: np.ndarray | None = None
    mass: np.ndarray | None = None

    @property
    def size(self) -> int:
        return self.k + 2

    def read(self, ids: pa.Array, more: pa.Array) -> tuple[_Flat, np.ndarray, np.ndarray]:
        """A batch's texts, and the classes and training counts of their words."""
        t = _Flat.of(ids)
        c, n = np.r_[self.cls, self.k][t.ids], np.r_[self.counts, 0][t.ids]
        at = np.flatnonzero(t.ids == len(self.cls))
        if len(at):
            begin = np.searchsorted(t.row[at], np.arange(t.rows))  # of each text's rare words
            size = np.diff(np.frombuffer(more.buffers()[1], np.int32, len(more) + 1, 4 * more.offset).astype(np.int64))
            found = more.flatten()
            k, cls, seen = (found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            place = at[np.repeat(begin, size) + k]
            c[place], n[place] = cls, seen
        return t, c, n

    def score(self, t: _Flat, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, base score) of each text; its end is counted."""
        rare = c == self.k
        p = np.log10(np.where(rare, (n + 0.5) / (self.mass[self.k] + 0.5 * (self.rare_types + 1)), n / np.maximum(self.mass[c], 1)))
        seq = t.spread(c, self.k + 1)
        moves = self.log_move[seq[:-1], seq[1:]]  # each ends at a word or at the end behind a text
        last = np.flatnonzero(np.bincount(t.at, minlength=len(seq)) == 0)[1:]
        base = np.log10((n + 0.5) / (self.total + 0.5 * (self.types + 1)))
        end = np.log10((self.end + 0.5) / (self.total + 0.5 * (self.types + 1)))
        sums = lambda x: np.bincount(t.row, x, t.rows)
        return sums(moves[t.at - 1] + p) + moves[last - 1], sums(base) + end


def transitions(train: DataFrame, model: Model) -> np.ndarray:
    """How often each class follows each one."""
    size, sent = model.size, train.sparkSession.sparkContext.broadcast(model)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, m = sent.value, np.zeros(size * size, np.int64)
        for b in batches:
            t, c, _ = model.read(b.column(0), b.column(1))
            if t.rows:
                seq = t.spread(c, size - 1)
                m += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
        m = m.reshape(size, size)
        yield from _matrix_rows({a: m[a] for a in np.flatnonzero(m.any(1)).tolist()})

    return added_up(train.select("ids", "more").mapInArrow(lean(summed), "a int, row binary"), size)


def finish(model: Model, m: np.ndarray) -> Model:
    """The model with its probabilities, from the class bigram counts."""
    p = (m.sum(0) + 0.5) / (m.sum() + 0.5 * model.size)
    model.log_move = np.log10((m + BACKOFF * p) / (m.sum(1, keepdims=True) + BACKOFF))
    model.mass = m.sum(0)
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(rows: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            t, c, n = model.read(b.column(2), b.column(3))
            score, base = model.score(t, c, n)
            size = np.bincount(t.row, minlength=t.rows) + 1
            known = np.bincount(t.row, n > 0, t.rows).astype(np.int64) + (model.end > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, f.type) for x, f in zip((size, known, np.full(t.rows, model.total), base, score), list(_SCORED)[2:], strict=True))], schema=_SCORED)

    return rows.select("doc_id", "held_out", "ids", "more").mapInArrow(lean(scored), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_scores(docs: DataFrame, max_known: int = 300_000, core: int = 4_000, floor: int = 2, classes: int = 64, rounds: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null text is empty (one end); rows with one doc_id are scored each on its own, a null
    doc_id trains; other columns are ignored. No rows give none; with nothing to learn
    from, every word is unknown.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), F.col("text").cast("string").alias("_text"))
    counts = saved(count_words(d.where(~F.col("held_out"))), "words")
    v = vocabulary(counts, max_known, core, max(floor, 1))
    forget(counts)
    encoded = saved(encode(d, v), "encoded")
    train = encoded.where(~F.col("held_out"))
    of, m = exchange(count_pairs(train, v), v, classes, rounds)
    k = m.shape[0] - 2
    cls = classes_of_known(train, v, of, m, k)
    rows = saved(sequences(encoded, classes_of_rare(train, v, of, m, k)), "sequences")
    forget(encoded)
    model = Model(k, cls, v.counts, v.total, v.types, v.rare_types, v.end)
    return scores(rows, finish(model, transitions(rows.where(~F.col("held_out")), model)))


def perplexity(scores: DataFrame, column: str = "score") -> float:
    """Perplexity per token of the held-out rows."""
    r = scores.where("held_out").agg(F.sum(column), F.sum("n_tokens")).first()
    return 10 ** (-r[0] / r[1])
