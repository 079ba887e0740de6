"""Repeated windows against a plain search for every one of them."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import substring_dedup as sd


def plain(rows, depth):
    docs = {}
    for d, t in rows:
        raw = (t or "").encode()
        docs[(d is not None, d, hashlib.sha256(raw).hexdigest())] = raw
    seen, out = set(), {}
    for name in sorted(docs, key=lambda k: (k[0], k[1] or 0, k[2])):
        raw, gone = docs[name], np.zeros(len(docs[name]) + 1, bool)
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            if w in seen:
                gone[s : s + depth] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[(name[1], name[2])] = (name[1], len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return sorted((out[(d, hashlib.sha256((t or "").encode()).hexdigest())] for d, t in rows), key=str)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    fill = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [fill(rng.randint(60, 300)) for _ in range(6)]
    rows = []
    for d in range(n):
        rows.append((d, "".join(fill(rng.randint(0, 150)) + (rng.choice(passages) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 4)))))
    edited = list(passages[0] + passages[1])
    edited[len(edited) // 2] = "#"
    rows += [(n, "".join(edited)), (n + 1, passages[0]), (n + 2, passages[0]), (n + 3, "z" * 700), (n + 4, "yz" * 400), (n + 5, None), (n + 6, ""), (n + 7, "z" * 99), (n + 8, "z" * 100)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    assert got(sd.substring_dedup(frame(spark, rows).repartition(5))) == plain(rows, 100)


def test_repeated_rows_and_ids(spark):
    rows = corpus(2, 20)
    rows += [rows[3], (5, "other " * 60), (5, rows[4][1] + "tail"), (None, "other " * 60), (None, None)]
    assert got(sd.substring_dedup(frame(spark, rows).repartition(3))) == plain(rows, 100)
    same = rows[:20] + [rows[3], rows[3]]
    assert got(sd.substring_dedup(frame(spark, same).repartition(3))) == plain(same, 100)


def test_busy_anchors_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUSY", 2)
    monkeypatch.setattr(sd, "CHUNK", 400)
    rows = corpus(3, 80)
    batch = [__import__("pyarrow").RecordBatch.from_pydict({"doc": [d for d, _ in rows], "raw": [(t or "").encode() for _, t in rows]})]
    spans = local(batch, 100)
    assert spans == local_plain(rows, 100)


def local(batches, depth, n=3):
    """The two passes without Spark."""
    import pyarrow as pa

    def through(rows, types, reduce, blob=False):
        held = sorted(((k, p) for b in rows for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: x[0])
        again = [pa.RecordBatch.from_pydict({"bucket": [k for k, _ in held], "payload": [p for _, p in held]})] if held else []
        return [r for cols, data in sd.packed.buckets(iter(again), types, blob) for b in reduce(cols, data) for r in b.to_pylist()]

    first = through(sd._anchored(depth, n)(iter(batches)), sd._BLOCKS, sd._by_anchor(depth))
    raw = {d: r for b in batches for d, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = {}
    for r in first:
        if r["kind"] == sd.BLOCK:
            want.setdefault(r["doc"], []).append(r)
    named = pa.RecordBatch.from_pydict({"doc": list(want), "raw": [raw[d] for d in want], "want": list(want.values())})
    second = through(sd._fetch(depth, n)(iter([named])), sd._WINDOWS, sd._compare(depth), True) if want else []
    out = {}
    for r in first + second:
        if r["kind"] == sd.SPAN:
            out.setdefault(r["doc"], set()).update(range(r["a"], r["b"]))
    return out


def local_plain(rows, depth):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            if w in seen:
                out.setdefault(d, set()).update(range(s, s + depth))
            seen.add(w)
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(96, 130), st.integers(1, 4))
def test_passes(seed, depth, letters):
    import pyarrow as pa

    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd"[:letters]) for _ in range(rng.randint(1, 200))) for _ in range(4)]
    rows = [(d, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for d in range(8)]
    batches = [pa.RecordBatch.from_pydict({"doc": [d for d, _ in rows], "raw": [t.encode() for _, t in rows]})]
    assert local(batches, depth) == local_plain(rows, depth)


def test_empty(spark):
    assert sd.substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sd.substring_dedup(frame(spark, []), depth=50)
