"""The join against all pairs, and each claim it rests on."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import ngram_join as nj
from stratalens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d)) for d, _ in rows)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    while len(rows) < n:
        kind = rng.random()
        if kind < 0.3 or not rows:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 40, 120, 300]))]
        elif kind < 0.5:
            words = [rng.choice(vocab) for _ in range(rng.randint(3, 60))] + passage
        elif kind < 0.55:
            words = rng.choice(rows).split()
        else:
            words = rng.choice(rows[-40:]).split()
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(words) + 1)
                if rng.random() < 0.5 and len(words) > 1:
                    del words[i - 1]
                else:
                    words.insert(i, rng.choice(vocab))
        rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(k * 3 + 1, r) for k, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("busy", [16, 2])
def test_against_all_pairs(spark, busy):
    rows = [*corpus(busy), (5000, None), (5001, ""), (5002, " \t"), (5003, "A b"), (5004, "a B"), (5005, "x " * 30_000)]
    assert got(nj.ngram_join(frame(spark, rows), busy)) == plain(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(base)) for k in range(60)]
    assert got(nj.ngram_join(frame(spark, rows), 8)) == plain(rows)


def test_busy_signatures_are_settled_in_their_task():
    """A signature of many documents is dealt once a task; every other holder is linked to the first and has lost it."""
    sig = np.r_[np.full(300, 7), np.arange(100, 110), np.full(3, 9)].astype(np.uint64)
    doc, scheme = np.r_[np.arange(300), np.arange(10), np.arange(3)] + (1 << 40), np.r_[np.full(300, 2), np.full(13, 3)]
    i, busy, notes = nj._settled(sig, doc, scheme, 16)
    assert len(i) == 14 and busy.sum() == 1 and sig[i[busy]].tolist() == [7] and doc[i[busy]].tolist() == [1 << 40]
    met = [(d, w - nj.MET, v | (f << 32)) for d, w, v, f in notes if w >= nj.MET]
    lost = [(d, w - nj.LOST, v) for d, w, v, _ in notes if nj.LOST <= w < nj.MET]
    assert met == [(d, 1, 1 << 40) for d in range((1 << 40) + 1, (1 << 40) + 300)] and lost == [(d, 2, 1) for d in range((1 << 40) + 1, (1 << 40) + 300)]
    many = nj._settled(np.repeat(np.arange(250, dtype=np.uint64), 3), np.tile([4, 5, 6], 250), np.zeros(750, np.int64), 2)
    assert [(d, w - nj.MET, v) for d, w, v, _ in many[2] if w >= nj.MET] == [(5, nj.MOST_MET, 4), (6, nj.MOST_MET, 4)] and [n[2] for n in many[2] if n[1] == nj.LOST] == [250, 250]
    # several first holders are each told
    two = nj._settled(np.repeat(np.arange(5, dtype=np.uint64), 3), np.array([1, 8, 9] * 2 + [2, 8, 9] * 3), np.zeros(15, np.int64), 2)
    assert sorted((d, w - nj.MET, v) for d, w, v, _ in two[2] if w >= nj.MET) == [(8, 2, 1), (8, 3, 2), (9, 2, 1), (9, 3, 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] != e[1]), max_size=40))
def test_forest(edges):
    """A forest's links connect what all links do, and none could be left out."""
    def parts(es):
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in es:
            root[find(a)] = find(b)
        return {frozenset(x for x in root if find(x) == r) for r in set(map(find, root))}

    kept = nj.forest(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64)).tolist()
    few = [edges[k] for k in kept]
    assert parts(few) == parts(edges) and len(few) == len({x for e in edges for x in e}) - len(parts(edges))


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "p q r s t"), (3, "u v w x y z"), (None, "a b c d e f")]
    out = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in nj.ngram_join(frame(spark, rows)).collect())
    assert out == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 2, 3)]
    kept = nj.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "component_id"] and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "a b c d e f"), ("3", "p q r s t"), ("3", "u v w x y z"), ("None", "a b c d e f")]


def test_links_of_every_text_of_an_id(spark):
    """Both texts of document 5 have a copy; both copies are linked with it, and the texts with each other only by name."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (6, a), (7, b), (8, b + " more"), (2, "x y"), (9, None), (9, "")]
    assert got(nj.ngram_join(frame(spark, rows))) == [(2, 1, 2), (5, 26, 5), (5, 26, 5), (6, 26, 5), (7, 26, 5), (8, 27, 5), (9, 0, 9), (9, 0, 9)]
    kept = sorted((r["doc_id"], r["text"]) for r in nj.keep_one(frame(spark, rows)).where("doc_id <> 9").collect())
    assert kept == [(2, "x y"), (5, a), (5, b)]
    unique = [(5, a), (6, a), (7, b), (8, b + " more"), (9, None), (10, "")]
    assert sorted(r["doc_id"] for r in nj.keep_one(frame(spark, unique)).collect()) == [5, 7, 9, 10]


def test_empty(spark):
    assert nj.ngram_join(frame(spark, [])).count() == 0


def test_bands():
    for s in range(1, 3000):
        k = int(nj.band(s))
        assert s <= nj.top(k) and (k == 0 or s > nj.top(k - 1))
        assert {int(nj.band(x)) for x in range(-(-3 * s // 4), s + 1)} == set(nj.schemes(s))
        for t in (s, s + 1, 4 * s // 3):
            if 4 * s >= 3 * t:
                assert (s + t) // 7 <= nj.may_differ(s, k) and (s + t) // 7 <= nj.may_differ(t, k)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_pigeonhole(seed, n):
    """Sets as different as a link allows still meet, by whole segments or by neighbourhoods, if either has enough."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 3 * n + 10).astype(np.uint64))
    x = np.sort(rng.choice(pool, n, replace=False))
    y = x.copy()
    for _ in range(n):
        z = np.delete(y, rng.integers(len(y))) if rng.random() < 0.5 and len(y) > 1 else np.union1d(y, rng.choice(pool, 1))
        if 100 * len(np.intersect1d(x, z)) < 75 * len(np.union1d(x, z)):
            break
        y = z
    small, large = sorted((x, y), key=len)
    k = int(nj.band(len(small)))
    assert k in nj.schemes(len(large))
    (a, _), (b, _) = nj.signatures(small, k), nj.signatures(large, k)
    if len(a) > nj.may_differ(len(small), k) or len(b) > nj.may_differ(len(large), k):
        assert np.intersect1d(a, b).size
    (p, _, cp), (q, _, cq) = nj.neighbourhoods(small, k), nj.neighbourhoods(large, k)
    if cp > nj.may_differ(len(small), k) or cq > nj.may_differ(len(large), k):
        assert np.intersect1d(p, q).size


def test_needs_agree(spark):
    sizes = [(n, int(k)) for n in (1, 2, 5, 15, 16, 17, 28, 29, 50, 51, 100, 333, 5000) for k in nj.schemes(n)]
    d = spark.createDataFrame(sizes, "n long, b long").select("n", "b", nj._need().alias("need"))
    assert all(r["need"] == nj.may_differ(r["n"], r["b"]) + 1 for r in d.collect())


def test_components(spark):
    rng = random.Random(3)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randrange(100), rng.randrange(100)) for _ in range(70)], [(1, 1)], []):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
        assert {r["doc"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
