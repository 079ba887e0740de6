"""Class bigrams: exact counts and base scores, a proper distribution, gains on held-out text."""

import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import class_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def plain(rows):
    from collections import Counter

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        x = tokens(t)
        out.append((d, held(d), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)))
    return sorted(out)


def corpus(n=1200):
    rng = random.Random(0)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "nva"]
    rows = []
    for d in range(n):
        words = [rng.choice(kinds[(p + d) % 3]) for p in range(rng.randint(0, 60))]
        words += [f"rare{d}x{i}" for i in range(rng.randint(0, 3))]
        rows.append((d, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, "N1 " * 20_000), (5002, "N1 " * 20_000), (5003, "never seen Words")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")


SMALL = {"max_known": 200, "core": 60, "classes": 4}


def test_base_and_counts(spark):
    rows = corpus()
    got = lm.class_scores(frame(spark, rows), **SMALL).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def plain_scores(rows, core, k, floor, of, m):
    """Every score from the core's classes: contexts, assignment, transitions and emissions counted one by one."""
    from collections import Counter

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    size, train = k + 2, [tokens(t) for d, t in rows if not held(d)]
    c = Counter(x for t in train for x in t)
    near = lambda w: of[core.index(w)] if w in core else k + 1 if w is None else k
    contexts = {}
    for t in train:
        for j, w in enumerate(t[:-1]):
            if w not in core and c[w] >= floor:
                contexts.setdefault(w, []).append((near(t[j - 1] if j else None), near(t[j + 1])))
    m = [[x for x in r] for r in m]
    out, into = [sum(r) for r in m], [sum(r[j] for r in m) for j in range(size)]
    cls = {w: int(of[j]) for j, w in enumerate(core)} | {None: k + 1}
    for w, seen in contexts.items():
        gain = [round(sum(math.log(m[p][j] + 0.5) - math.log(into[j] + 0.5) + math.log(m[j][q] + 0.5) - math.log(out[j] + 0.5) for p, q in seen), 6) for j in range(k)]
        cls[w] = gain.index(max(gain))
    move = Counter((cls.get(a, k), cls.get(b, k)) for t in train for a, b in zip([None, *t[:-1]], t))
    after, mass = Counter(), Counter()
    for (a, b), n in move.items():
        after[a] += n
        mass[b] += n
    n_all, v = sum(c.values()), sum(1 for w in c if w is not None and c[w] < floor)
    result = []
    for d, t in rows:
        x, score = tokens(t), 0.0
        for a, b in zip([None, *x[:-1]], x):
            p, q = cls.get(a, k), cls.get(b, k)
            back = (mass[q] + 0.5) / (n_all + 0.5 * size)
            score += math.log10((move[p, q] + lm.BACKOFF * back) / (after[p] + lm.BACKOFF))
            score += math.log10((c[b] + 0.5) / (mass[k] + 0.5 * (v + 1)) if q == k else c[b] / mass[q])
        result.append((d, score))
    return sorted(result)


def some_core(spark, rows, max_known, core, k, floor, rounds=6):
    d = frame(spark, rows).select("doc_id", lm.held_out_column().alias("held_out"), lm.F.col("text").alias("_text"))
    v = lm.vocabulary(lm.count_words(d.where("NOT held_out")), max_known, core, floor)
    return v, *lm.exchange(lm.count_pairs(lm.saved(lm.encode(d, v), "t").where("NOT held_out"), v), v, k, rounds)


def test_against_plain_scores(spark):
    """However many words travel, scores are those of the plain count, also where words that do not travel follow one another."""
    rng = random.Random(2)
    rows = corpus(300) + [(8000 + d, " ".join(f"seldom{rng.randrange(60)}" for _ in range(rng.randint(2, 9)))) for d in range(100)]
    for known, floor in ((200, 2), (70, 2), (70, 3), (1000, 1)):
        v, of, m = some_core(spark, rows, known, 40, 4, floor)
        want = plain_scores(rows, [w.decode() for w in v.words[: v.clustered]], 4, floor, of.tolist(), m.tolist())
        got = sorted((r["doc_id"], r["score"]) for r in lm.class_scores(frame(spark, rows), known, 40, floor, 4).collect())
        assert v.clustered == 40 and len(v.words) <= known and [d for d, _ in got] == [d for d, _ in want]
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for (_, x), (_, y) in zip(got, want))


def test_beats_unigrams_on_held_out_text(spark):
    s = lm.saved(lm.class_scores(frame(spark, corpus()[:1200]), **SMALL), "t")
    assert lm.perplexity(s) < 0.7 * lm.perplexity(s, "base_score")


def test_classes_grow_with_the_corpus(spark):
    """Words outside the core are classed by their neighbours."""
    rows = corpus()
    d = frame(spark, rows).select("doc_id", lm.held_out_column().alias("held_out"), lm.F.col("text").alias("_text"))
    v, of, m = some_core(spark, rows, 100, 60, 3, 2)
    train = lm.saved(lm.encode(d, v), "t").where("NOT held_out")
    cls = lm.classes_of_known(train, v, of, m, 3)
    groups = {}
    for w, c in zip(v.words, cls.tolist()):
        groups.setdefault(w[:1], []).append(c)
    for r in lm.classes_of_rare(train, v, of, m, 3).where("n > 1").collect():
        if bytes(r["word"])[1:].isdigit():
            groups[bytes(r["word"])[:1]].append(r["class"])
    assert sum(map(len, groups.values())) == 120
    assert sum(max(map(g.count, set(g))) for g in groups.values()) > 114


def test_exchange_finds_the_classes(spark):
    rows = corpus()
    v, of, m = some_core(spark, rows, 200, 120, 3, 2, 12)
    groups = {}
    for w, c in zip(v.words[: v.clustered], of):
        groups.setdefault(w[:1], []).append(c)
    pure = sum(max(map(g.count, set(g))) for g in groups.values()) / v.clustered
    assert v.clustered == 120 and pure > 0.95 and m.sum() == sum(len(tokens(t)) for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1)


def test_probabilities_sum_to_one(spark):
    """Every word type of the model and the unknown word have one in all after any class."""
    rows = corpus(300)
    train = [x for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for x in tokens(t)]
    n_of = {w: train.count(w) for w in set(train)}
    cls = np.array([k % 3 for k in range(len(n_of) - 1)])
    counts = np.array([n for w, n in n_of.items() if w is not None])
    cls[counts < 2] = 3
    model = lm.Model(3, cls, counts, len(train), len(n_of), int((counts < 2).sum()), n_of[None])
    mass = np.bincount(cls, counts, 5)
    mass[4] = n_of[None]
    m = np.outer(mass, mass) / mass.sum()
    lm.finish(model, m)
    assert np.allclose((10**model.log_move).sum(1), 1) and np.allclose(model.mass, mass)
    c, n = np.r_[cls, 3], np.r_[counts, 0]  # a text of one word for each
    one = np.arange(len(c))
    score, _ = model.score(lm._Flat(one, one, 2 * one + 1, len(c)), c, n)
    assert math.isclose((10 ** (score - model.log_move[c, 4])).sum() + 10 ** model.log_move[4, 4], 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_gain_of_a_move(seed):
    """The gain equals the change of the likelihood, counted anew."""
    rng = np.random.default_rng(seed)
    k, size, words = 3, 5, 7
    text = rng.integers(0, words, 200)
    of = np.r_[rng.integers(0, k, words - 2), 3, 4]
    m = np.zeros((size, size))
    np.add.at(m, (of[text[:-1]], of[text[1:]]), 1)
    w = 0
    a, b = text[:-1], text[1:]
    right = np.bincount(of[b[(a == w) & (b != w)]], minlength=size).astype(float)
    left = np.bincount(of[a[(b == w) & (a != w)]], minlength=size).astype(float)
    to, gain = lm.best_move(m, int(of[w]), right, left, float(((a == w) & (b == w)).sum()), k)
    best = []
    for c in range(k):
        new = of.copy()
        new[w] = c
        n = np.zeros((size, size))
        np.add.at(n, (new[a], new[b]), 1)
        best.append(lm.likelihood(n))
    assert math.isclose(max(best) - lm.likelihood(m), gain, abs_tol=1e-6) and math.isclose(best[to], max(best), abs_tol=1e-6)


def test_empty(spark):
    assert lm.class_scores(frame(spark, [])).count() == 0
    only_held = [(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 5 == 1]
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in lm.class_scores(frame(spark, only_held)).collect())
