"""Personal data against the patterns as stated, and disclosure against a plain count."""

import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111", "+49 (30) 123-4567", "+1", " ", "x", ".", "5", "é", "\n"]), max_size=12).map("".join))
def test_base(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("v " + "1" * 5000 + ".1.1.1 " + "0" * 5000 + "7.1.1.1", [("ip", 5009, 5009 + 5007)]),
        ("x" * 1_000_000 + " a@b.co", [("email", 1_000_001, 1_000_007)]),
        ("x" * 1_000_000 + "@", []),
        ("@" * 300_000 + "a@b.co", [("email", 300_000, 300_006)]),
        ("1" * 1_000_000 + ".", []),
        ("1." * 300_000, [("ip", 8 * k, 8 * k + 7) for k in range(75_000)]),
        ("+1" + " " * 1_000_000, []),
        ("4 " * 500_000, []),
        ("a." * 300_000 + "@", []),
    ],
    ids=range(9),
)
def test_long_runs(text, want):
    began = time.perf_counter()
    assert pii.base_spans(text) == want
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("piece", ["1.2.3.4 ", "a@b.co word ", "a@b.co\n"])
def test_many_spans(piece):
    """Ten thousand spans, with and without words between them, take time in proportion."""
    text = "Dear all " + piece * 10_000
    began = time.perf_counter()
    spans = pii.base_spans(text)
    near = pii.contexts(text, spans, 8)
    assert len(spans) == 10_000 and {t for _, t, _ in near} == {"dear", "all"} | ({"word"} if "word" in piece else set())
    assert len(pii.free_words(text, spans)) == 2 + 10_000 * ("word" in piece)
    assert time.perf_counter() - began < 5


def corpus():
    rng = random.Random(0)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    rows = [fill(60) for _ in range(400)]
    for k in range(6):
        rows.append(f"{fill(20)} Zorro wrote from z@zorro.org {fill(20)}")
    rows += [rows[-1]] * 5  # copies of a context are one context
    rows += [f"{fill(5)} quux 10.0.0.1 the end"] * 9
    return list(enumerate(rows))


def plain_pairs(rows, reach, theta, support):
    near, ent, term = {}, {}, {}
    for k, (_, t) in enumerate(rows):
        for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())):
            term.setdefault(w, set()).add(k)
        spans = plain(t)
        for kind, s, e in spans:
            words = [m for m in re.finditer(r"[^\W\d_]{2,}", t[:s])][-reach:] + list(re.finditer(r"[^\W\d_]{2,}", t[:0] + " " * e + t[e:]))[:reach]
            words = [m for m in words if not any(a < m.end() and m.start() < b for _, a, b in spans)]
            name = pii.entity_of(kind, t[s:e])
            ent.setdefault(name, set()).add(k)
            ctx = " ".join(m[0].lower() for m in words)
            for m in words:
                near.setdefault((name, m[0].lower()), set()).add((k, ctx))
    n, out = len(rows), set()
    for (e, t), seen in near.items():
        if len({c for _, c in seen}) >= support:
            info = math.log2(n / len(ent[e]))
            if info > 0 and math.log2(n * len({k for k, _ in seen}) / (len(term[t]) * len(ent[e]))) >= theta * info:
                out.add((e, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")


def test_disclosure(spark):
    rows = corpus()
    d = pii._inner(frame(spark, rows))
    found = pii.saved(pii.find(d, ["doc_id"], 8), "t")
    want = plain_pairs(rows, 8, 0.9, 3)
    assert ("email:z@zorro.org", "zorro") in want and not any(t == "quux" for _, t in want)
    assert {tuple(r) for r in pii.disclosing(found, d, 0.9, 3).collect()} == want
    n = {}
    for _, t in rows:
        for w in set(re.findall(r"[^\W\d_]{2,}", t.lower())):
            n[w] = n.get(w, 0) + 1
    assert {r["term"]: r["n_term"] for r in pii.term_documents(d).collect()} == n and n["zorro"] == 11


def test_query(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "a@b.co " * 4000), (902, "a@b.co " * 4000)]
    assert pii.pii(frame(spark, [(1, "v " + "1" * 5000 + ".1.1.1")])).first()["n_ip"] == 0
    got = {}
    for r in pii.pii(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        base = plain(t or "")
        for r in got[d]:
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in base) for k in pii.KINDS[:4]]
            assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(",")) | {""}
            assert ("term:" in r["spans"]) == ("Zorro" in (t or ""))
    assert len(got[902]) == 2 and pii.pii(frame(spark, [])).count() == 0


@pytest.mark.parametrize("closure_pairs", [200_000, 0])
def test_sanitise(spark, closure_pairs):
    docs = frame(spark, [*corpus(), (900, None), (901, "call +49 30 1234567 now")])
    out = pii.sanitise(docs, closure_pairs=closure_pairs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[900] is None and got[901] == "call [PHONE] now"
    assert "Zorro" not in got[401] and "[NAME]" in got[401] and "[EMAIL]" in got[401]
    assert sum(got[d] == t for d, t in corpus()) == 400  # rows come in any order


def test_rare_entities_are_judged(spark):
    """Two contexts are enough where the corpus is large; one is not, nor are words that stand elsewhere too."""
    rows = [(k, f"filler word{chr(97 + k % 26)} elsewhere") for k in range(2000)]
    rows += [(3000 + k, f"{w} Zorro z@zorro.org {w} elsewhere") for k, w in enumerate(["aa", "bb"])]
    rows += [(4000, "hapax once@other.com words"), (4001, "hapax once@other.com words")]
    d = pii._inner(frame(spark, rows))
    found = pii.saved(pii.find(d, ["doc_id"], 8), "t")
    got = {tuple(r) for r in pii.disclosing(found, d, 0.8, 3).collect()}
    assert got == {("email:z@zorro.org", "zorro")}
    assert pii.disclosing(found, d, 0.9, 3).count() == 0  # the bound of two of two is 0.32, (2 / 2004) ** 0.1 is 0.50


def test_terms_far_from_the_entity(spark):
    """A name in the greeting is tied to the address in the signature, and marked wherever it stands there."""
    rng = random.Random(1)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    letters = [(1000 + k, f"Dear Zorro, {fill(20)} zorro {fill(20)} z@other.org {fill(9)}") for k in range(4)]
    docs = frame(spark, [*((k, fill(60)) for k in range(400)), *letters])
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.pii(docs).collect()}
    for d, t in letters:
        assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)zorro", t)} <= set(spans[d])
    for closure_pairs in (200_000, 0):
        got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, closure_pairs=closure_pairs).where("doc_id >= 1000").collect()}
        assert all("zorro" not in t.lower() and "[NAME], " in t and "[TERM]" in t and "[EMAIL]" in t for t in got.values())
