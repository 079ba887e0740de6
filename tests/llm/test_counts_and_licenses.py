"""Edited counts against whole encoding; licence finds against planted notices and a plain alignment."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import licenses as li
from stratalens.llm import token_counts as tc
from stratalens.llm.tokenizer import default_path, encoder


def full(text):
    return len(encoder(default_path()).tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40))
def test_edits(seed, leaf):
    rng = random.Random(seed)
    bits = ["the ", "cat", " don't", "'s", "  ", "\n", " é", "日本", " 12", "x" * 30, ". ", " ", "<|endoftext|>"]
    fill = lambda n: "".join(rng.choice(bits) for _ in range(n))
    text = fill(rng.randint(0, 120))
    tree = tc.CountTree(text, encoder(default_path()), leaf)
    assert tree.total == full(text) and tree.text() == text
    for _ in range(5):
        s = rng.randint(0, len(text))
        e = rng.randint(s, min(len(text), s + 12))
        new = fill(rng.choice([0, 1, 3, 60]))
        tree.edit(s, e, new)
        text = text[:s] + new + text[e:]
        assert tree.text() == text and tree.total == full(text)
        again = tc.CountTree.restored(text, *[x or [0] for x in tree.kept()], encoder(default_path()), leaf)
        assert again.total == tree.total and again.encoded == 0


def test_only_touched_regions_are_encoded():
    text = "some words in a row " * 5000
    tree = tc.CountTree(text, encoder(default_path()))
    tree.encoded = 0
    tree.edit(50_000, 50_004, "other")
    assert 0 < tree.encoded < 4 * tc.LEAF


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")


def test_counts_query(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org and call +49 30 1234567 " * 50), (3, "plain"), (4, "w " * 50_000)]
    got = sorted(tc.edited_counts(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0], full(r[1] or "")))):
        t = t or ""
        after = t
        for s, e, new in sorted(tc.sanitising_edits(t), reverse=True):
            after = after[:s] + new + after[e:]
        assert (r["doc_id"], r["n_tokens"], r["n_tokens_after"], r["n_chars_after"]) == (d, full(t), full(after), len(after))
    assert tc.edited_counts(frame(spark, [])).count() == 0
    first = tc.edited_counts(frame(spark, rows[2:3]), lambda t: [])
    edits = spark.createDataFrame([(3, 0, 4, "post"), (3, 100, 103, "")], "doc_id long, start int, end int, new string")
    t = rows[2][1]
    t = "post" + t[4:100] + t[103:]
    r = tc.recount(frame(spark, rows[2:3]), first, edits).first()
    assert r["n_tokens_after"] == full(t) and r["n_chars_encoded"] < len(t)


def plain_best(a, b):
    """Best local score without a band."""
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(0, 5), max_size=8))
def test_alignment(a, b):
    matched, first, end = li.align(np.array(a), np.array(b), 0, band=20)
    assert (matched > 0) == (plain_best(a, b) > 0) and 0 <= first <= end <= len(b)
    assert matched <= end - first and 2 * matched >= plain_best(a, b)


def test_every_template_is_found():
    index = li.Index(li.TEMPLATES)
    for name, text in li.TEMPLATES:
        got = li.scan(index, f"Noise before. {text} noise behind", 0.8)
        assert [g[0] for g in got] == [name] and got[0][1] == 1
        s, e = got[0][2:]
        assert f"Noise before. {text} noise behind"[s:e].strip(" .,;)(") == text.strip(" .,;)(")


def test_edited_notice_and_shared_runs():
    index = li.Index(li.TEMPLATES)
    got = li.scan(index, "this work is HEREBY licensed under the gnu general public license version 3", 0.8)
    assert [g[0] for g in got] == ["GPL-3.0"]
    rng = random.Random(0)
    for _ in range(200):  # any run of K + WINDOW - 1 words that is shared nominates
        t = rng.randrange(len(index.words))
        w = index.words[t]
        n = li.K + li.WINDOW - 1 if len(w) > li.SHORT else 2
        s = rng.randrange(len(w) - n + 1)
        ids = np.r_[np.zeros(5, np.int64), w[s : s + n], np.zeros(3, np.int64)]
        assert any(k == t and abs(begin - (5 - s)) <= li.BAND for k, begin in index.nominate(ids))


def plain_align(a, b):
    """(matched, first, end) of the best local alignment anywhere, from the whole table."""
    h = {}
    best = (0, 0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            s, k, f = h.get((i - 1, j - 1), (0, 0, j))
            options = [(s + 2, k + 1, f) if a[i] == b[j] else (s - 1, k, f)]
            options += [(x[0] - 1, x[1], x[2]) for x in (h.get((i - 1, j)), h.get((i, j - 1))) if x]
            cell = max(options, key=lambda c: c[0])
            h[i, j] = cell if cell[0] > 0 else (0, 0, j + 1)
            best = max(best, (*h[i, j], j + 1), key=lambda c: c[0])
    return best[1:]


def test_against_every_template_everywhere():
    """Notices with words changed or left out: found if and only if alignment without a band or an index accepts them, at its span."""
    rng = random.Random(5)
    seen = {True: 0, False: 0}
    for name, text in [*li.TEMPLATES, *li.HEADERS[-5:]]:
        index = li.Index([(name, text)])
        words = [w.decode() for w in li.words_of(text)]
        for _ in range(12):
            # neither the first nor the last word, which would move the span
            own = [w if k in (0, len(words) - 1) or rng.random() > 0.15 else rng.choice(["", f"changed{k}"]) for k, w in enumerate(words)]
            around = [f"noise{k}" for k in range(30)]
            whole = [*around[: rng.randrange(1, 30)], *filter(None, own), *around]
            ids = [index.vocabulary.get(w.encode(), 0) or -1 for w in whole]
            matched, first, end = plain_align(index.words[0].tolist(), ids)
            want = matched >= 0.8 * len(words)
            got = li.scan(index, " ".join(whole), 0.8)
            assert bool(got) == want, (name, whole)
            seen[want] += 1
            if want:
                assert got[0][1] == matched / len(words) and " ".join(whole)[got[0][2] : got[0][3]] == " ".join(whole[first:end])
    assert min(seen.values()) > 50
    assert [g[0] for g in li.scan(li.Index([("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")]), "Licensed under CC XX-NC 4.0", 0.8)] == ["CC-BY-NC-4.0"]


def test_scan_query(spark):
    rows = [(1, None), (2, ""), (3, "Text.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0."), (3, "clean"), (4, "w " * 50_000)]
    got = sorted((r["doc_id"], r["n_licenses"], r["licenses"], r["spans"]) for r in li.license_scan(frame(spark, rows)).collect())
    assert got == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (3, 2, ["CC-BY-NC-4.0", "MIT"], "MIT:6:36:100,CC-BY-NC-4.0:44:71:100"), (4, 0, [], "")]
    assert li.license_scan(frame(spark, [])).count() == 0


def test_full_texts_and_headers(spark):
    """Whole texts are one find from their first word to their last; one changed word does not shrink it."""
    texts = [(n, "\n\n".join(parts)) for n, parts in li.full_texts()]
    docs = [f"Noise before it. {t}" for _, t in texts] + [f"Noise. {t} noise" for _, t in li.HEADERS]
    docs.append(docs[li.TEXTS.index("MIT")].replace("obtaining", "getting"))
    got = {r["doc_id"]: r for r in li.license_scan(frame(spark, list(enumerate(docs)))).collect()}
    for k, name in enumerate([*li.TEXTS, *(n for n, _ in li.HEADERS), "MIT"]):
        n, s, e, c = got[k]["spans"].rsplit(":", 3)
        assert (got[k]["n_licenses"], n) == (1, name), (name, got[k]["spans"])
        assert int(s) <= 60 and int(e) > len(docs[k]) - 60 and int(c) >= 98, (name, got[k]["spans"], len(docs[k]))
    broken = docs[li.TEXTS.index("BSD-2-Clause")].replace("Redistributions in binary form", "Copies in binary form").replace("COPYRIGHT HOLDERS", "REGENTS")
    assert [f[0] for f in li.scan(li.Index([*li.TEMPLATES, *li.HEADERS], li.full_texts()), broken, 0.8)] == ["BSD-2-Clause"]
