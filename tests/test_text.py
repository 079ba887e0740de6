import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import contexts, sketch, text

DOCS = [(0, "The cat sat on the mat, the CAT!"), (1, "a dog sat"), (2, None), (3, "  "), (4, "naïve café_1 ２ cat")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def toks(t):
    return re.findall(r"\w+", (t or "").lower())


def test_tokens(docs):
    got = {r[0]: r[1] for r in docs.select("doc_id", text.tokens(F.col("text"))).collect()}
    assert got == {d: toks(t) for d, t in DOCS}
    folded = docs.select("doc_id", text.tokens(F.col("text"), fold=True)).collect()[4][1]
    assert "2" in folded
    assert docs.select(text.tokens(F.col("text"), min_length=3)).first()[0] == ["the", "cat", "sat", "the", "mat", "the", "cat"]


def test_shingles(docs):
    got = {r[0]: r[1] for r in docs.select("doc_id", text.shingles(text.tokens(F.col("text")), 3)).collect()}
    assert got[1] == ["a dog sat"] and got[2] == [] and len(got[0]) == 6


def test_idf_and_tfidf(docs):
    tf = text.term_counts(docs)
    df = Counter(w for _, t in DOCS for w in set(toks(t)))
    for name, f in {"smooth": lambda n, k: math.log((n + 1) / (k + 1)) + 1, "rsj": lambda n, k: math.log(1 + (n - k + 0.5) / (k + 0.5)), "plain": lambda n, k: math.log(n / k)}.items():
        got = {r["token"]: r["idf"] for r in text.idf(tf, 5, name).collect()}
        assert got.keys() == df.keys() and all(math.isclose(got[w], f(5, df[w])) for w in df)
    w = text.tfidf(tf, text.idf(tf, 5)).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(math.isclose(r["n"], 1) for r in w)


def test_cooccurrence(spark):
    d = spark.createDataFrame([(0, "a b a c"), (1, "b")], "doc_id long, text string")
    v = text.vocabulary(text.term_counts(d), 0)
    got = {(r["a"], r["b"]): r["n"] for r in text.cooccurrence(d, v, 2).collect()}
    want = Counter()
    t = "a b a c".split()
    for i in range(4):
        for j in range(i + 1, min(4, i + 3)):
            want[t[i], t[j]] += 2
            want[t[j], t[i]] += 2
    assert got == want
    e = {r["a"]: r for r in text.contextual_entropy(text.cooccurrence(d, v, 2)).collect()}
    assert 0 <= e["a"]["normalised"] <= 1


def test_set_similarity(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["x"])], "a array<string>, b array<string>")
    rows = d.select(*[c.alias(n) for n, c in text.set_similarity(F.col("a"), F.col("b")).items()]).collect()
    assert [round(rows[0][k], 6) for k in ("jaccard", "containment", "overlap", "dice")] == [0.333333, 0.5, 0.5, 0.5]
    assert all(rows[1][k] == 1 for k in ("jaccard", "containment", "overlap", "dice"))
    assert rows[2]["jaccard"] == 0 and rows[2]["containment"] == 1


def test_bloom_has_no_false_negatives(spark):
    items = spark.range(2000).select(F.concat(F.lit("w"), "id").alias("token"))
    bits, k = sketch.bloom_size(2000, 0.01)
    b = sketch.bloom_build(items, "token", bits, k)
    assert sketch.bloom_probe(items, "token", b, bits, k).where("NOT present").count() == 0
    other = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("token"))
    assert sketch.bloom_probe(other, "token", b, bits, k).where("present").count() < 60


def test_count_min_never_underestimates(spark):
    c = spark.range(500).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 17 + 1).alias("n"))
    w, d = sketch.count_min_size(0.01, 0.01)
    e = sketch.count_min_estimate(c, "token", sketch.count_min(c, "token", w, d), w, d).join(c, "token")
    total = c.agg(F.sum("n")).first()[0]
    assert e.where("estimate < n").count() == 0 and e.where(F.col("estimate") > F.col("n") + 0.01 * total).count() <= 10


def test_hll(spark):
    x = spark.range(50_000).select((F.col("id") % 20_000).cast("string").alias("token"))
    assert abs(sketch.hll_estimate(sketch.hll_registers(x, "token")).first()[0] / 20_000 - 1) < 0.06


def test_minhash_estimates_jaccard(spark):
    d = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog " * 3), (1, "the quick brown fox jumps over the lazy cat " * 3), (2, ""), (3, None)], "doc_id long, text string")
    s = sketch.minhash(d)
    a, b = (x.select("signature").first()[0] for x in (s.where("doc_id = 0"), s.where("doc_id = 1")))
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (d.collect()[0][1], d.collect()[1][1])]
    true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    assert abs(np.mean(np.array(a) == np.array(b)) - true) < 0.15
    assert s.where("signature IS NULL").count() == 2
    assert sketch.lsh_groups(s, 64).count() > 0


def plain_ctph(text, size):
    """Every piece, then all of its digits, of which 64 stay."""
    import base64
    import struct

    def fnv(cs):
        h = 0xCBF29CE484222325
        for c in cs:
            h = ((h ^ c) * 0x100000001B3) % 2**64
        return h

    raw = text.encode("utf-16-le")
    units = [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]
    parts = []
    for k in (size, 2 * size):
        pieces, start = [], 0
        for i in range(len(units)):
            if fnv(units[: i + 1]) % k == k - 1:
                pieces.append(fnv(units[start : i + 1]))
                start = i + 1
        if start < len(units):
            pieces.append(fnv(units[start:]))
        parts.append(base64.b64encode(b"".join(struct.pack("<Q", p) for p in pieces)).decode()[:64])
    return f"{size}:{parts[0]}:{parts[1]}"


def test_fuzzy_hashes():
    base = "some words that go on for a while and then some more of them, é日𝄞 " * 4
    assert sketch.ctph(base) == plain_ctph(base, 3) and sketch.ctph(base, 9) == plain_ctph(base, 9) and sketch.ctph("ab") == plain_ctph("ab", 3)
    assert sketch.ctph("") == sketch.ctph(None) == "0::" and sketch.ctph("ab", 1).startswith("3:")
    assert [sketch.ctph("x" * n).split(":")[0] for n in (4095, 4096, 5000, 1 << 20)] == ["3", "6", "7", "14"]
    t = sketch.tlsh(base)
    assert sketch.tlsh("short") == sketch.tlsh("x" * 49) == "" and len(t) == 133 and t[:2] == "T1" and int(t[2:4], 16) == sum(base.encode()) % 256 and int(t[4], 16) == 8
    units = [ord(c) & 255 for c in "abcdefghij" * 6]
    n = [0] * 256
    for i in range(len(units) - 4):
        h = 0
        for c in units[i : i + 5]:
            h = ((h ^ c) * 31) % 256
        n[h] += 1
    q = [sorted(n)[k] for k in (64, 128, 192)]
    codes = [sum(x > y for y in q) for x in n]
    assert sketch.tlsh("abcdefghij" * 6)[5:] == bytes(sum(codes[4 * i + j] << 2 * j for j in range(4)) for i in range(64)).hex()


def test_fuzzy_similarity(spark):
    rows = [("3:abcd:x", "3:abce:y"), ("3:aa:wxyz", "6:bb:wxyy"), ("3:a:b", "7:a:b"), ("0::", "0::"), ("0::", "3:a:b")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(sketch.ctph_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [75, 75, 0, 100, 0]
    t = [sketch.tlsh(x) for x in ("abcdefghij" * 6, "abcdefghij" * 6 + "k" * 70)]
    d = spark.createDataFrame([tuple(t)], "a string, b string").select(sketch.tlsh_distance(F.col("a"), F.col("b"))).first()[0]
    assert d == 12 * abs(int(t[0][4], 16) - int(t[1][4], 16)) + abs(int(t[0][2:4], 16) - int(t[1][2:4], 16)) + sum(x != y for x, y in zip(t[0][5:], t[1][5:]))


def test_long_texts_are_compressed_in_one_window(spark):
    import random

    rng = random.Random(0)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    d = spark.createDataFrame([(a, a), ("", None)], "a string, b string")
    got = [r[0] for r in d.select(sketch.compression_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] < 0.05 and got[1] == 0
    assert d.select(sketch.compression_distance(F.col("a"), F.col("b"), "zlib")).first()[0] > 0.9


def test_compression_and_tlsh_distance(spark):
    a, b = "words and more words " * 30, "entirely different content here " * 30
    d = spark.createDataFrame([(a, a, b)], "a string, b string, c string")
    r = d.select(sketch.compression_distance(F.col("a"), F.col("b")), sketch.compression_distance(F.col("a"), F.col("c"))).first()
    assert r[0] < 0.3 < r[1]
    t = d.select(sketch.tlsh_column("a").alias("a"), sketch.tlsh_column("b").alias("b"), sketch.tlsh_column("c").alias("c"))
    r = t.select(sketch.tlsh_distance(F.col("a"), F.col("b")), sketch.tlsh_distance(F.col("a"), F.col("c"))).first()
    assert r[0] == 0 < r[1]


def test_best_of_block_leaves_out_what_cannot_count(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "HELD", 50)
    rng = np.random.default_rng(0)
    d, q = rng.integers(0, 4, (300, 6)).astype(float), rng.integers(1, 4, (7, 6)).astype(float)
    start, query = np.arange(7) * 7, np.tile(np.arange(7), 6)
    run = text._best_of_block(list(range(7)), {f"t{i}": i for i in range(6)}, start, query, q.T.ravel(), 3, True)
    rows = pa.RecordBatch.from_pydict({"id": np.arange(300), "tokens": [[f"t{i}" for i in range(6)]] * 300, "weights": d.tolist()})
    got = sorted(zip(*(c.to_pylist() for b in run([rows]) for c in b.columns)))
    s = d @ q.T
    assert got == sorted((j, i, s[i, j]) for j in range(7) for i in sorted((i for i in range(300) if i != j), key=lambda i: (-s[i, j], i))[:3])


def brute_neighbours(texts, k, window=5):
    cells = Counter()
    for t in map(toks, texts):
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + window + 1)):
                cells[t[i], t[j]] += 2
                cells[t[j], t[i]] += 2
    m = Counter()
    for (a, _), n in cells.items():
        m[a] += n
    total, best = sum(m.values()), {}
    for (a, b), n in cells.items():
        best.setdefault(a, []).append((-round(max(0.0, math.log(n * total / (m[a] * m[b] + 1e-10))), 9), b, n))
    return {(a, b, n, -p, i + 1) for a, rows in best.items() for i, (p, b, n) in enumerate(sorted(rows)[:k])}


@pytest.mark.parametrize("chunk, spread", [(60, 20), (1 << 21, 1 << 22)])
def test_ppmi_best(spark, monkeypatch, chunk, spread):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.zipf(1.3, 4000) % 900]
    texts = [" ".join(words[i : i + int(n)]) for i, n in zip(range(0, 4000, 20), rng.integers(0, 40, 200))]
    texts += [None, "", "alone", "x x x x x x x", "é ñ é z" * 3, *texts[:9], " ".join(words[:900])]
    monkeypatch.setattr(contexts, "SPREAD", spread)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in contexts.ppmi_best(d, 3, chunk=chunk).collect()}
    want = brute_neighbours(texts, 3)
    assert {r[:3] + r[4:] for r in got} == {r[:3] + r[4:] for r in want}
    assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)], atol=2e-9)
    assert contexts.ppmi_best(d.where("text = 'alone'")).count() == contexts.ppmi_best(d.where("false")).count() == 0


def test_ppmi_writes_less_than_its_pairs(spark, monkeypatch):
    """What is kept on disk between the steps, against a row for each pair of words from either side."""
    rng, sizes, save = np.random.default_rng(5), {}, contexts.saved
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.2, 400) % 20000) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    def measured(df, name, *rest):
        out = save(df, name, *rest)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out.inputFiles()[0]).getParent()
        sizes[name] = sizes.get(name, 0) + hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
        return out

    monkeypatch.setattr(contexts, "saved", measured)
    contexts.ppmi_best(d)
    measured(text.cooccurrence(d), "pairs")
    assert sum(sizes[n] for n in ("coded", "words", "cells", "best")) < sizes["pairs"]
