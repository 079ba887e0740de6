"""The pipeline against its stages' plain meaning, on the small table."""

import re

import corpus_pipeline as cp
import pytest

from stratalens.llm import decontaminate, quality
from stratalens.llm.common import saved
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(saved(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns(stages):
    assert all(d.columns == cp.COLUMNS and dict(d.dtypes) == dict(stages[0].dtypes) for d in stages[:-1])


def test_quality(stages, spark):
    before, after = rows(stages[0]), rows(stages[1])
    judged = {r["doc_id"]: r for r in quality.quality_rules(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(after) == {d for d, r in judged.items() if r["kept"]} and all(after[d] == before[d] for d in after)


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {d: shingle_set(r["text"]) for d, r in before.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert set(after) == {d for d in sets if find(d) == d} and all(after[d] == before[d] for d in after)


def test_decontamination(stages, spark):
    before, after = rows(stages[2]), rows(stages[3])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x.decode() for x in decontaminate.words_of(r["text"])]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = set()
    for d, r in before.items():
        w = [x.decode() for x in decontaminate.words_of(r["text"])]
        if any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            hit.add(d)
    assert set(after) == set(before) - hit and hit
    assert plain_hits([], []) == []


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == set(before)
    for d, r in after.items():
        spans = plain_spans(before[d]["text"])
        if spans:
            assert not any(before[d]["text"][s:e] in r["text"] for k, s, e in spans if k != "ip" and e - s > 8)
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r == before[d]


def test_packing(stages):
    docs = [(d, r["text"], "") for d, r in rows(stages[4]).items()]
    assert check_packing(docs, stages[5].collect(), 2048) < 0.05


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = saved(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == stages[-1].count()


def test_rows_that_tables_should_not_have(spark):
    """Nulls in every column, one doc_id with several texts, equal rows, long runs and columns named like the operators' own."""
    long = " ".join(f"w{k}" for k in range(20_000))
    fine = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    names = ["_text", "doc", "uid", "spans", "n_words", "stratum", "digest", "text2", "a", "kept"]
    rows = [
        (1, fine[0], "en"), (1, fine[1], "en"), (1, fine[1], "en"), (2, fine[1], None), (3, long, "en"), (4, None, "en"), (5, "", ""), (None, fine[2], None),
        (6, "9" * 5000 + ".1.1.1 " + fine[3], "de"), (7, "x" * 200_000 + "@ " + " ".join(fine[3].split()[::-1]), "de"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, None, len(r[1] or ""), *(["z"] * len(names))) for r in rows], schema)
    want = sorted([("1", fine[0]), ("1", fine[1]), ("3", long), ("None", fine[2]), ("6", rows[8][1]), ("7", rows[9][1])])
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, docs, SF), "t")
        if name == "packing":
            break
        assert docs.columns == [*cp.COLUMNS, *names]
        if name != "quality":
            assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == want
    assert docs.where("start = 0").count() == len(want)
