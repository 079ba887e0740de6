"""Quality rules with risk-controlled thresholds.

Each rule has a fixed ladder of cutoffs, from the one that rejects least to the one
that rejects most. Labelled documents are grouped by their least shingle (near copies
mostly share it), each group counts once, and a quarter of the groups, by a hash, tune:

* A rung is *worth while* if at least half of what it rejects is bad and it rejects at
  most ``alpha`` / 2 of the good ones. Each rule's strictest such rung ends its ladder.
* The rules are put in order, the one that catches most first, and their ladders up to
  there make one chain of steps, each of which adds a rung to all before it.

The other groups certify: the steps are tested in order, and a step passes if the
exact binomial probability of seeing so few good documents rejected by it and all steps
before, were the true rate ``alpha``, is at most ``delta`` over the number of strata.
Testing stops at the first failure. So (fixed sequence in a chain, Bonferroni among
strata) with probability 1 - delta no stratum loses more than ``alpha`` of its good
documents, whatever the rules do together.

Power: without a wrong rejection ln(delta / strata) / ln(1 - alpha) good groups are
needed to certify anything, 217 in each of four strata at 0.02 and 0.05. Strata that
have fewer are certified together, as one stratum for which the promise then holds.

All labelled documents are used. Up to ``SENT`` labels travel to the texts; beyond, texts
and labels are shuffled to each other. ``max_labels``, where given, takes about so many
labels, those whose id's hash is least.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, small_batches, texts

#: Per rule: whether low values are bad, and the cutoffs from lenient to strict.
#: A document is rejected at a rung if its value lies beyond the cutoff.
RULES: dict[str, tuple[bool, list[int]]] = {
    "few_words": (True, [12, 15, 20, 25, 30, 40]),  # words
    "long_words": (False, [3000, 2000, 1500, 1200, 1000, 900, 800]),  # characters in 100 words
    "short_words": (True, [150, 200, 250, 300, 350, 400]),  # characters in 100 words
    "symbols": (False, [1000, 500, 300, 200, 100, 50, 20]),  # in 1000 words
    "dup_lines": (False, [800, 600, 500, 400, 300, 200, 100]),  # in 1000 lines with a word
    "repeats": (False, [175, 150, 125, 100, 75, 50, 25]),  # repeated words in 1000
}

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines"]
_WHITE = [bytes([c]) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = h[:n] * _MIX[0]
    for j in range(1, width):
        key = (key ^ (key >> np.uint64(29))) * _MIX[j % 5] + h[j : j + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # equal keys only nominate: the windows themselves decide
    at = np.flatnonzero(np.isin(key, twice)).tolist()
    windows = [tuple(words[i : i + width]) for i in at]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows, strict=True):
        if found[w] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def counts_of(text: str) -> tuple[int, int, int, int, int, int]:
    """The counts named in ``COUNTS`` of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - sum(map(data.count, _WHITE))
    symbols = sum(map(data.count, _SYMBOLS))
    if b"\n" in data:
        lines = [x for x in data.split(b"\n") if x.strip()]
        n_lines, dup = len(lines), len(lines) - len(set(lines))
    else:
        n_lines, dup = int(bool(words)), 0
    return len(words), chars, symbols, dup, repeat_words(words), n_lines


def values(row: dict[str, int]) -> dict[str, int]:
    """Each rule's integer value."""
    n, lines = max(row["n_words"], 1), max(row["n_lines"], 1)
    return {
        "few_words": row["n_words"], "long_words": 100 * row["word_chars"] // n, "short_words": 100 * row["word_chars"] // n,
        "symbols": 1000 * row["n_symbols"] // n, "dup_lines": 1000 * row["n_dup_lines"] // lines, "repeats": 1000 * row["n_repeat_words"] // n,
    }


def _value_columns() -> dict:
    per = lambda k, a, b: F.expr(f"{k} * {a} div greatest({b}, 1)")
    chars = per(100, "word_chars", "n_words")
    return {"few_words": F.col("n_words"), "long_words": chars, "short_words": chars, "symbols": per(1000, "n_symbols", "n_words"), "dup_lines": per(1000, "n_dup_lines", "n_lines"), "repeats": per(1000, "n_repeat_words", "n_words")}


def rung(rule: str):
    """Column: the first rung (from 1) at which ``rule`` rejects; one more than there are if none does."""
    low, ladder = RULES[rule]
    v = _value_columns()[rule]
    out = None
    for k, c in enumerate(ladder, 1):
        hit = v < c if low else v > c
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(len(ladder) + 1)


def group_of(text: str, width: int = 5) -> str:
    """Names a group of near copies: the least MD5 of the text's shingles, in hex."""
    words = text.encode("utf-8", "surrogatepass").split()
    return min((hashlib.md5(b" ".join(words[i : i + width])).hexdigest() for i in range(max(1, len(words) - width + 1))), default="")


def with_counts(docs: DataFrame, keep: list[str], group: bool = False) -> DataFrame:
    """``docs``' columns ``keep``, the counts of its whole texts (null: no words) and, if asked for, their groups.

    ``keep`` must not hold names of ``COUNTS``; the operators below rename before.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    if group:
        schema = schema.add("grp", "string")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts(b, "_text")
            rows = np.array([counts_of(x) for x in t], np.int64).reshape(-1, len(COUNTS))
            more = [pa.array([group_of(x) for x in t], pa.string())] if group else []
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array(rows[:, k]) for k in range(len(COUNTS))), *more], names=schema.names)

    return docs.select(*keep, "_text").mapInArrow(lean(counted), schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from its exact terms."""
    if n <= 0:
        return 1.0
    top = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


#: Sixteenths of the groups that tune.
TUNING = 4
#: Labels that are broadcast; more are joined by a shuffle.
SENT = 2_000_000


def chain(tune: pd.DataFrame, alpha: float) -> list[tuple[str, int]]:
    """(rule, last rung) of the rules that are worth while, best first, from rule, first, quality, n of the tuning groups."""
    good_total = int(tune.loc[(tune["quality"] == 1) & (tune["rule"] == next(iter(RULES))), "n"].sum())
    out = []
    for rule, (_, ladder) in RULES.items():
        own = tune[tune["rule"] == rule]
        for j in range(len(ladder), 0, -1):
            hit = own[own["first"] <= j]
            bad, good = (int(hit.loc[hit["quality"] == q, "n"].sum()) for q in (0, 1))
            if bad and bad >= good and 2 * good <= alpha * good_total:
                out.append((-bad, rule, j))
                break
    return [(rule, j) for _, rule, j in sorted(out)]


def certified(steps: dict[int, int], total: int, alpha: float, delta: float) -> int:
    """The last step that passes (0: none); ``steps`` counts the good held-out groups by the step that first rejects them."""
    last = wrong = 0
    for j in range(1, sum(len(ladder) for _, ladder in RULES.values()) + 1):
        wrong += steps.get(j, 0)
        if binomial_cdf(wrong, total, alpha) > delta:
            break
        last = j
    return last


def key_of(stratum: str):
    """Column: a stratum's name, null apart from every value."""
    return F.when(F.col(stratum).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(stratum).cast("string")))


def graded(d: DataFrame, labels: DataFrame, max_labels: int | None = None, sent: int = SENT) -> DataFrame:
    """(key, tunes, quality, counts): one row for each group of labelled documents of a stratum that pass the base rules.

    ``d`` holds doc_id, stratum, _text. Up to ``sent`` labels are broadcast.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    lab = saved(lab.withColumn("at", F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long")), "labels")
    n = lab.count()
    if max_labels is not None and n > max_labels:
        lab, n = lab.where(F.col("at") < int(max_labels / n * 2**32)), max_labels
    lab = lab.drop("at")
    some = with_counts(d.join(F.broadcast(lab) if n <= sent else lab.hint("merge"), "doc_id").select("doc_id", key_of("stratum").alias("key"), "quality", "_text"), ["doc_id", "key", "quality"], group=True)
    each = some.where(~base_failed()).groupBy("key", "grp").agg(F.min(F.struct("doc_id", "quality", *COUNTS)).alias("x"))
    tunes = F.conv(F.substring(F.sha2("grp", 256), 1, 1), 16, 10).cast("int") < TUNING
    return each.select("key", tunes.alias("tunes"), "x.quality", *[F.col(f"x.{c}").alias(c) for c in COUNTS])


def cutoffs(d: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_labels: int | None = None) -> DataFrame:
    """(key, rule, last): the certified rung of each stratum and rule; strata without labels have no rows.

    What comes to the driver is bounded by the strata and the rungs, not by documents.
    """
    spark = d.sparkSession
    rows = saved(graded(d, labels, max_labels), "graded")
    total = {r["key"]: r["n"] for r in rows.groupBy("key").agg(F.count(F.when(~F.col("tunes") & (F.col("quality") == 1), 1)).alias("n")).collect()}
    need = math.log(delta / max(len(total), 1)) / math.log1p(-alpha)
    small = [k for k, n in total.items() if n < need]
    unit = {k: "" if k in small else k for k in total}  # keys are never empty
    names = sorted(set(unit.values()))
    units = rows.withColumn("unit", F.when(F.col("key").isin(small), F.lit("")).otherwise(F.col("key")) if small else F.col("key"))
    firsts = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rung(r).alias("first")) for r in RULES]))
    tune = units.where("tunes").select("unit", "quality", firsts.alias("r")).groupBy("unit", "quality", "r.rule", "r.first").agg(F.count("*").alias("n")).toPandas()
    chains = {u: chain(tune[tune["unit"] == u], alpha) for u in names}
    out = []
    for u in names:
        step, start = None, 0
        for rule, j in chains[u]:
            here = F.when(rung(rule) <= j, rung(rule) + start)
            step, start = here if step is None else F.least(step, here), start + j
        if step is None:
            continue
        seen = {r["step"]: r["n"] for r in units.where(~F.col("tunes") & (F.col("quality") == 1) & (F.col("unit") == u)).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
        last, start = min(start, certified(seen, sum(seen.values()), alpha, delta / len(names))), 0
        for rule, j in chains[u]:
            out += [(k, rule, max(0, min(j, last - start))) for k in total if unit[k] == u]
            start += j
    return saved(spark.createDataFrame(out, "key string, rule string, last int"), "cutoffs")  # of known size


def judge(counted: DataFrame, cut: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Adds base_failed and kept. The join is on the stratum; Spark broadcasts the cutoffs if they are small."""
    per = cut.groupBy(F.col("key").alias("_key")).agg(*[F.max(F.when(F.col("rule") == r, F.col("last"))).alias(f"_{r}") for r in RULES])
    j = counted.withColumn("_own", key_of(stratum)).join(per, F.col("_own") == F.col("_key"), "left")
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | (rung(r) <= F.coalesce(F.col(f"_{r}"), F.lit(0)))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | beyond)).drop("_own", "_key", *[f"_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, max_labels: int | None = None) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, kept: one row per row of ``docs``.

    Null text has no words and fails the base rules. Rows with one doc_id are judged each
    on its own; a null stratum is a stratum of its own; labels that contradict one another
    count as bad. Other columns are ignored. No rows give none.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("_text"))
    return judge(with_counts(d, ["doc_id", "stratum"]), cutoffs(d, labels, alpha, delta, max_labels))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, max_labels: int | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns, whatever they are called; texts are not shuffled."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("_text"))
    cut = cutoffs(d, labels, alpha, delta, max_labels)
    names = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("_text"))
    judged = judge(with_counts(inner, [*names.values(), "stratum"]), cut)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
