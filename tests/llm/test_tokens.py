"""Tokenisation, Simple-8b files and packing: exact round trips against the library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import packing, simple8b, token_output
from stratalens.llm.tokenizer import PieceEncoder, default_path, encoder

TEXTS = [
    None, "", " ", "a", "Hello, world's  best\n\n thing'll <|endoftext|> end", "x" * 50_000, "the cat " * 5_000,
    "日本語 テキスト and русский текст", "don't 'tis ''re 've\t\ttabs \r\n 123abc 4'5", " 　 odd space\x1c ", "the cat " * 5_000, "é'é 'É́ ",
]


def rows():
    return [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, "a", "repeat")]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, start string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_pieces_equal_library(texts):
    e = encoder(default_path())
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "'", "'s", ".", "12", "日", "<|endoftext|>", "́"]), max_size=14).map("".join))
def test_pieces_around_white_space(text):
    e = encoder(default_path())
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_on_odd_texts():
    e = encoder(default_path())
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_runs_of_letters_need_the_model_only(monkeypatch):
    e = PieceEncoder(default_path())
    monkeypatch.setattr(e.pieces, "run", None)  # the whole library takes over twice as long for each new word
    texts = ["Some words, überall où Ångström", "日本語", " Ġødegård ŭ ÿ", "a" * 3000 + " " + "éß" * 500]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_a_library_with_more_steps(tmp_path):
    """Where a normaliser or a token of letters has a say, the model alone is not asked."""
    from tokenizers import AddedToken, Tokenizer, normalizers

    for k in range(2):
        t = Tokenizer.from_file(default_path())
        if k:
            t.add_tokens([AddedToken("zqx")])
        else:
            t.normalizer = normalizers.Lowercase()
        t.save(str(tmp_path / f"{k}.json"))
        e = PieceEncoder(str(tmp_path / f"{k}.json"))
        assert e.pieces.tokenize is None
        assert e.encode(["A Word", "zqx"])[k].tolist() == t.encode(["A Word", "zqx"][k], add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v, block)
    assert (simple8b.decode(words, offsets, len(v), block) == v).all()
    for k in range(len(offsets)):
        assert (simple8b.decode_block(words, offsets, len(v), k, block) == v[k * block : (k + 1) * block]).all()


def test_simple8b_is_word_aligned_and_small():
    words, _ = simple8b.encode(np.ones(1020, np.uint64))
    assert len(words) == 1020 // 60


def expected(text, end):
    e = encoder(default_path())
    return e.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_output(spark):
    got = sorted(tuple(r) for r in token_output.token_output(frame(spark, rows()), segment_ids=1000).collect())
    want, start = [], 0
    for d, t, _ in sorted(rows(), key=lambda r: r[0]):
        ids = np.array(expected(t, 2), "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_token_files_keep_the_ids(spark, tmp_path):
    token_output.write_ids(frame(spark, rows()), str(tmp_path / "ids"))
    segments = token_output.read_ids(spark, str(tmp_path / "ids")).orderBy("part", "segment").collect()
    got = [(d, x.tolist()) for s in segments for d, x in zip(s["doc_ids"], token_output.decode_segment(s))]
    assert got == [(d, expected(t, 2)) for d, t, _ in sorted(rows(), key=lambda r: r[0])]


@pytest.mark.parametrize("op", [token_output.token_output, packing.pack])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0


def check_packing(rows, pieces, size, end=1):
    left = {}
    for p in pieces:
        left.setdefault(p["doc_id"], []).append(p)
    sequences = {}
    for d, t, _ in rows:
        ids = np.array(expected(t, end), "<u4")
        at = 0
        for p in sorted(left[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            sequences.setdefault(p["sequence_id"], []).append(p)
        assert at == len(ids)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(total, 1)


def test_packing(spark):
    rng = np.random.default_rng(0)
    data = [(k, t, "") for k, t in enumerate(TEXTS)] + [(100 + k, "the cat sat " * int(n), "") for k, n in enumerate(rng.integers(1, 900, 400))]
    got = packing.pack(frame(spark, data).repartition(5), n_open=16).collect()
    assert check_packing(data, got, 2048) < 0.06


def test_windows_hold_what_they_say():
    w = packing.Windows(10, 2)
    assert w.put("a", 6) is None and w.put("b", 7) is None
    assert w.put("c", 3) == ["b", "c"]  # best fit fills the second
    assert w.put("d", 5) is None and w.put("e", 8) == ["a"]  # none fits: the fullest goes
