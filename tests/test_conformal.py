"""Conformal operators against plain counts and the promises they make."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.functions.ordering import cumulative
from stratalens.operators import conformal as cf


def test_cumulative(spark):
    rows = [(s, k, float(k % 7)) for s in ("a", "b", None) for k in range(300)]
    df = spark.createDataFrame(rows, "s string, k long, v double").repartition(5)
    got = {(r["s"], r["k"]): (r["x"], r["x_all"], r["n"]) for r in cumulative(df, ["s"], [F.col("k")], {"x": F.col("v"), "n": F.lit(1)}, total=True).collect()}
    c = np.cumsum([k % 7 for k in range(300)])
    assert got == {(s, k): (c[k], c[-1], k + 1) for s in ("a", "b", None) for k in range(300)}
    assert cumulative(df.limit(0), ["s"], [F.col("k")], {"x": F.col("v")}).count() == 0


def test_training_conditional():
    rng = np.random.default_rng(0)
    n, alpha, beta = 99, 0.1, 0.9
    k = cf.safe_level(n + 1, alpha, beta)
    u = np.sort(rng.random((20_000, n)), 1)
    assert 0 < k < 10 and (u[:, k - 1] <= alpha).mean() > beta > (u[:, k] <= alpha).mean()
    assert math.isclose(np.quantile(u[:, 9], beta), cf.miscoverage(100, 10, beta), abs_tol=0.002)
    assert cf.miscoverage(100, 0, 0.9) == 0 and cf.safe_level(5, 0.1, 0.9) == 0


@pytest.mark.parametrize("n, m", [(1, 1), (4, 3), (6, 2)])
def test_rank_law_and_boxes(n, m):
    every = list(itertools.combinations_with_replacement(range(1, n + 2), m))
    for order in range(1, m + 1):
        want = [sum(r[order - 1] == k for r in every) / len(every) for k in range(1, n + 2)]
        assert np.allclose(cf.rank_law(n, m, order), want)
        lo, hi, c = cf.batch_ranks(n, m, order, 0.2, 0.2)
        assert math.isclose(c, sum(lo <= r[order - 1] <= hi for r in every) / len(every)) and c >= 0.6 - 1e-9
    b = {1: (1, 2), m: (2, n + 1)}
    assert math.isclose(cf.box_coverage(n, m, b), sum(all(lo <= r[j - 1] <= hi for j, (lo, hi) in b.items()) for r in every) / len(every))
    box = cf.simultaneous(n, m, list(range(1, m + 1)), 0.5)
    assert cf.box_coverage(n, m, box) >= 0.5


def test_batch_ranks_of_many_scores_are_exact():
    n = 1_196_460
    lo, hi, c = cf.batch_ranks(n, 5, 3, 0.05, 0.05)
    # of five test scores, three or more before the k-th of n
    upto = lambda k: sum(math.comb(k - 1 + j, j) * math.comb(n - k + 5 - j, 5 - j) for j in (3, 4, 5))
    assert (lo, hi) == (226_437, 970_025) and abs(c - (upto(hi) - upto(lo - 1)) / math.comb(n + 5, 5)) < 1e-14


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), min_size=1, max_size=12), st.floats(0.02, 0.98))
def test_loss_bound(losses, x):
    rng = np.random.default_rng(1)
    law = cf.LossBound(losses, 1.0)
    w = rng.dirichlet(np.ones(len(losses) + 1), 20_000)
    draws = w @ law.knots
    assert abs(law.below(x) - (draws <= x).mean()) < 0.02 and math.isclose(law.mean, (sum(losses) + 1) / (len(losses) + 1))
    assert abs(law.below(law.gaffke(0.9)) - 0.9) < 1e-6 or law.knots[0] == law.knots[-1]


def test_binary_losses():
    for wrong, n in ((0, 20), (3, 20), (20, 20)):
        assert math.isclose(cf.binary_bound(wrong, n, 0.95), cf.LossBound([1.0] * wrong + [0.0] * (n - wrong), 1.0).gaffke(0.95), abs_tol=1e-6)


def test_cv_plus_both_ways(spark):
    rng = np.random.default_rng(2)
    res = [(int(f), float(r)) for f, r in zip(rng.integers(0, 4, 60), np.round(rng.normal(0, 3, 60), 2))]
    pred = [(c, f, float(np.round(rng.normal(c, 1), 2))) for c in range(6) for f in range(4)]
    r, p = spark.createDataFrame(res, "fold int, residual double"), spark.createDataFrame(pred, "case int, fold int, prediction double")
    k = math.floor(0.1 * 61)
    want = {}
    for c in range(6):
        mu = {f: x for d, f, x in pred if d == c}
        want[c] = (sorted(mu[f] - abs(e) for f, e in res)[k - 1], sorted((mu[f] + abs(e) for f, e in res), reverse=True)[k - 1])
    for most in (10**6, 5):
        got = {x["case"]: (x["lower"], x["upper"]) for x in cf.cv_plus(r, p, 0.1, most).collect()}
        assert all(np.allclose(got[c], want[c], atol=1e-9) for c in want)
    assert cf.cv_plus(r.limit(3), p, 0.1).first()["lower"] == -math.inf


def test_equal_weights_are_the_plain_rule(spark):
    from stratalens.operators.monitor import split_conformal

    rows = [("a", k, float((k * 37) % 101), 1.0) for k in range(200)] + [("b", k, float(k), 1.0) for k in range(5)]
    c = spark.createDataFrame(rows, "stratum string, seq long, score double, weight double")
    cases = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, 1.0)], "stratum string, case long, weight double")
    t = {r["stratum"]: r["threshold"] for r in cf.weighted_thresholds(c, cases, 0.1).collect()}
    assert t["a"] == {r["stratum"]: r["threshold"] for r in split_conformal(c, 0.1).collect()}["a"] and t["b"] == -math.inf == t["c"]


def test_streams():
    t = cf.OrderStatistics()
    assert [t.add(x) for x in (3, 1, 3, 2, 3)] == [(0, 1), (0, 1), (1, 2), (1, 1), (2, 3)]
    w = np.array([0.5, 2.0, 1.0, 0.0, 3.0])
    for k in (1, 2, 3):
        sets = list(itertools.combinations(range(5), k))
        chance = np.array([np.prod(w[list(s)]) for s in sets])
        want = [sum(c for s, c in zip(sets, chance) if j in s) / chance.sum() for j in range(5)]
        assert np.allclose(cf.inclusion(w, k), want)
    rng = np.random.default_rng(0)
    p = []
    for seed in range(60):  # the stream follows the law that the weights name
        x = rng.random(30)
        y = np.sqrt(rng.random(4))
        s = cf.ShiftedPValues(x, 2 * x, seed)
        p += [s.add(v, 2 * v) for v in y]
    assert abs(np.mean(p) - 0.5) < 0.08 and abs(np.var(p) - 1 / 12) < 0.03
    with pytest.raises(ValueError):
        s.add(0.0, 0.0)


def test_density_ratio(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(float(x),) for x in rng.normal(0, 1, 4000)], "x double")
    b = spark.createDataFrame([(float(x),) for x in rng.normal(1, 1, 2000)], "x double")
    beta = cf.density_ratio(a, b, ["x"])
    assert np.allclose(beta, [-0.5, 1.0], atol=0.12)
    assert abs(a.agg(F.avg(cf.ratio_column(beta, ["x"]))).first()[0] - 1) < 0.1


def test_high_density_and_boundary(spark):
    rows = [("a", k, float(k)) for k in range(99)]
    r = cf.high_density_level(spark.createDataFrame(rows, "stratum string, seq long, score double"), 0.1, 0.9).first()
    assert r["k"] == cf.safe_level(100, 0.1, 0.9) and r["threshold"] == r["k"] - 1
    assert math.isclose(cf.boundary(lambda x: x < 2.5, 0, 10), 2.5)
    losses = spark.createDataFrame([(g, u, float(u >= 10 * g)) for g in range(1, 11) for u in range(100)], "grid int, unit int, loss double")
    assert [x["grid"] for x in cf.risk_threshold(losses, 0.1).where("chosen").collect()] == [10]
    assert [x["grid"] for x in cf.risk_threshold(losses, 0.1, 0.95).where("chosen").collect()] == [10]
