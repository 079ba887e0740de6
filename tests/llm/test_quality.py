"""Quality rules against plain counting, and the bound that the cutoffs promise."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    c = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if c[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(lines)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", " ", "\t", "\x0b", "\x85", " "]), max_size=60))
def test_counts(parts):
    text = "".join(parts)
    assert quality.counts_of(text) == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeats(words):
    text = " ".join(words)
    assert quality.counts_of(text) == plain(text)


def test_binomial():
    assert math.isclose(quality.binomial_cdf(2, 5, 0.3), sum(math.comb(5, i) * 0.3**i * 0.7 ** (5 - i) for i in range(3)))
    assert quality.binomial_cdf(0, 0, 0.1) == 1.0


def test_certified_steps_keep_their_promise():
    """Over many draws, a certified step whose true rate exceeds alpha is rare."""
    rng = np.random.default_rng(1)
    alpha, delta, wrong = 0.02, 0.05, 0
    for _ in range(400):
        good = Counter(rng.choice([1, 2, 3, 0], 1000, p=[0.005, 0.012, 0.013, 0.97]).tolist())  # three steps truly lose 3 %
        wrong += quality.certified(good, 1000, alpha, delta) >= 3
    assert wrong <= 400 * delta
    assert quality.certified({}, 100, alpha, delta) == 0 and quality.certified({}, 149, alpha, delta) > 0


def test_copies_count_once():
    """A wrong rejection copied many times is one; copies of one clean document do not buy power."""
    words = [f"w{k}" for k in range(200)]
    same = [quality.group_of(" ".join(words)) == quality.group_of(" ".join(words[:k] + ["other"] + words[k + 1 :])) for k in range(200)]
    assert sum(same) > 185 and quality.group_of(" ".join(words)) == quality.group_of("  \n".join(words)) != quality.group_of(" ".join(words[::-1]))


def test_chain():
    rows = [(r, 1 if r == "symbols" else 8 if r != "repeats" else 2, 0, 9) for r in quality.RULES]
    rows += [(r, 8, 1, 1000) for r in quality.RULES] + [("repeats", 3, 1, 11), ("symbols", 2, 1, 10)]
    tune = pd.DataFrame(rows, columns=["rule", "first", "quality", "n"])
    # rung 3 of repeats loses too many good ones; few_words rejects nobody before its own end
    assert quality.chain(tune[tune["rule"].isin(["symbols", "repeats", "few_words"])], 0.02) == [("repeats", 2), ("symbols", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")


def test_edge_cases(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "word " * 12, "en", "x"), (3, "word " * 12, "en", "x"), (4, " ".join(map(str, range(40_000))), None, "x")]
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(frame(spark, rows), labels).collect()
    assert sorted((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in got) == [(1, 0, True, False), (2, 0, True, False), (3, 12, True, False), (3, 12, True, False), (4, 40_000, False, True)]
    assert quality.quality_rules(frame(spark, []), labels).count() == 0
    assert quality.quality_rules(frame(spark, rows), labels.limit(0)).count() == 5
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "n_words"] and [r["doc_id"] for r in kept.collect()] == [4]


def test_rules_reject_what_labels_call_bad(spark):
    rng = np.random.default_rng(0)
    rows, lab = [], []
    for k in range(6000):
        bad = k % 4 == 0
        words = [f"w{x}" for x in rng.integers(0, 10_000, 30)]
        rows.append((k, " ".join(["#" * 9 if bad and i % 2 else w for i, w in enumerate(words)]), "en" if k < 5500 else None if k < 5990 else "", ""))
        lab.append((k, int(not bad), 0))
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    # the empty stratum has ten labels: too few; with half of the labels the null one has too few as well
    for more, upto in (({}, 5990), ({"max_labels": 3000}, 5500)):
        got = quality.quality_rules(frame(spark, rows), labels, **more).collect()
        assert {r["doc_id"] for r in got if not r["kept"]} == set(range(0, upto, 4))
    kept = quality.keep_good(frame(spark, rows), labels)
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(6000) if k % 4 or k >= 5990}
    # twenty labels certify nothing
    assert all(r["kept"] for r in quality.quality_rules(frame(spark, rows), labels.where("doc_id < 20")).collect())


def test_all_labels_count(spark):
    n = 210_000
    d = spark.range(n).selectExpr("id AS doc_id", "'en' AS stratum", "array_join(transform(sequence(1, 10), k -> concat(id, '_', k)), ' ') AS _text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(1 AS INT) AS quality")
    assert quality.graded(d, labels).count() == n
    some = d.where("doc_id < 500"), labels.where("doc_id < 400")
    assert quality.graded(*some, sent=10).count() == 400  # by a shuffle


def test_kept_rows_rest_on_all_labels(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(quality, "graded", lambda d, labels, most, old=quality.graded: (asked.append(most), old(d, labels, most))[1])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(frame(spark, [(0, " ".join("abcdefghijkl"), "en", "")]), labels).count() == 1 and asked == [None]


def test_something_is_certified_on_the_driver_tables(spark):
    """The method rejects documents beyond the base rules there, and no good one."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("NOT base_failed AND NOT kept")
    q = [r["quality"] for r in got.join(labels, "doc_id", "left").collect()]
    assert len(q) > 50 and q.count(0) > 20 and q.count(1) == 0
