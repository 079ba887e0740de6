"""Decontamination against a plain search for every window."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, bench, width=10):
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for i, bt in bench:
            b = words(bt)
            k = min(width, len(b))
            for j in range(len(b) - k + 1) if b else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[j : j + k]:
                        hit |= set(range(p, p + k))
                        items |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


BENCH = [(1, "a b c d e f g h i j k l"), (2, "x Y"), (3, None), (4, "..."), (5, "e f g h i j k l m n o p q r s t"), (5, "solo"), (None, "zz yy ww")]
DOCS = [(1, "q A-b c D e f g h i j k l m n o p q r s t x"), (2, None), (3, ""), (4, "x y x y"), (4, "x y x y"), (5, "Solo zz yy ww zz yy"), (6, "w " * 30_000 + "x y"), (7, "x"), (8, "y é b c d")]


@pytest.mark.parametrize("block_words", [2_000_000, 7])
def test_against_plain(spark, block_words):
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = dc.decontamination(docs, bench, block_words=block_words).collect()
    assert sorted(tuple(r)[:6] for r in got) == plain(DOCS, BENCH)
    kept = dc.keep_clean(docs, bench, block_words=block_words)
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in plain(DOCS, BENCH) if not r[5])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 4))
def test_suffix_array(ids, shortest):
    """Every suffix of a long enough run, in the order of its words up to the run's end."""
    x = np.array(ids, np.uint32)
    run = lambda p: next((q for q in range(p, len(ids)) if ids[q] == 0), len(ids))
    first = lambda p: next((q + 1 for q in range(p, -1, -1) if ids[q] == 0), 0)
    want = sorted((p for p in range(len(ids)) if ids[p] and run(p) - first(p) >= shortest), key=lambda p: (ids[p : run(p)], p))
    sa = dc.SuffixArray(x, shortest)
    assert sa.array.tolist() == want
    for word in (1, 2, 3):
        lo, hi = sa.narrowed(np.array([0]), np.array([len(want)]), 0, np.array([word]))
        assert sa.array[lo[0] : hi[0]].tolist() == [p for p in want if ids[p] == word]


def test_long_runs():
    """A run of one word, as long as a shard: ranks are doubled, not compared word by word."""
    x = np.ones(300_000, np.uint32)
    assert (dc.SuffixArray(x, 3).array == np.arange(300_000)[::-1]).all()


def test_longest_in_the_query(spark):
    docs = spark.createDataFrame([*DOCS, (30, None)], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for block_words in (2_000_000, 7):
        got = {r["doc_id"]: r["longest"] for r in dc.decontamination(docs, bench, block_words=block_words).collect()}
        assert got == {1: 16, 2: 0, 3: 0, 4: 2, 5: 3, 6: 2, 7: 0, 8: 0, 30: 0}


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert dc.decontamination(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in dc.decontamination(docs, bench.limit(0)).collect())


def test_longest_matches(spark):
    docs = spark.createDataFrame(DOCS[:1], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH[:1] + BENCH[4:5], "item_id long, text string")
    got = {tuple(r) for r in dc.matches(docs, bench).collect()}
    assert got == {(1, "1", 0, 1, 12), (1, "5", 0, 5, 16)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=8), max_size=4), st.integers(2, 5))
def test_shard(docs, bench, width):
    docs, bench = [" ".join(d) for d in docs], [(str(k), " ".join(b)) for k, b in enumerate(bench)]
    probe = dc.Probe(bench, width)
    sizes, found = dc._shard(probe, docs)
    got = [(k, n, sum(e - s for s, e in dc._union(probe, *f)), len(dc._items(probe, f[0]))) for k, (n, f) in enumerate(zip(sizes, found))]
    assert got == [r[:4] for r in plain(list(enumerate(docs)), bench, width)]
    for (w, p), text in zip(found, docs):
        t = text.split()
        for item, j, at, n in dc.longest(probe, w, p):
            b = bench[int(item)][1].split()
            assert t[at : at + n] == b[j : j + n]
            assert j == 0 or at == 0 or t[at - 1] != b[j - 1]
            assert j + n == len(b) or at + n == len(t) or t[at + n] != b[j + n]


def test_many_copies_of_one_passage():
    rng = np.random.default_rng(0)
    docs = [" ".join(map(str, rng.integers(0, 50, 200))) + " a b c d e f g h i j" for _ in range(300)]
    probe = dc.Probe([("p", "a b c d e f g h i j"), ("q", "9 9 9")], 10)
    assert all(len(w) >= 1 for w, _ in dc._shard(probe, docs)[1])
