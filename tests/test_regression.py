"""Splines against definitions, samplers against truths, sensitivities against integrals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import splines as sp
from stratalens.operators import regression as rg

rng = np.random.default_rng(0)


def test_basis():
    k = sp.Knots((0.2, 0.5, 0.9), degree=3)
    x = np.linspace(0, 1, 101)
    b = sp.design(x, k)
    assert b.shape == (101, k.dimension) == (101, 7) and np.allclose(b.sum(1), 1) and b.min() >= 0 and math.isclose(b[0, 0], 1) and math.isclose(b[-1, -1], 1)
    even = sp.design(x, sp.Knots.even(6, 0, 1, extended=True))
    assert np.allclose(even.sum(1), 1) and np.allclose(np.diff(even @ np.arange(9.0), n=2), 0)
    hats = sp.design(x, sp.Knots.even(4, 0, 1, 1))
    assert np.allclose(hats, np.maximum(0, 1 - np.abs(x[:, None] - np.linspace(0, 1, 5)) * 4))
    c = np.linalg.lstsq(b, x**3 - x, rcond=None)[0]
    assert np.allclose(b @ c, x**3 - x)  # cubics are in the space
    y, w = rng.normal(size=101), rng.random(101)
    bands, cross, square, n = sp.banded_sums(x, y, k, w)
    assert np.allclose(sp.unbanded(bands), b.T @ (w[:, None] * b)) and np.allclose(cross, b.T @ (w * y)) and math.isclose(square, (w * y * y).sum()) and math.isclose(n, w.sum())
    assert (sp.step_design([0.1, 0.5, 0.95], [0.5, 0.9]) == np.eye(3)[[0, 1, 2]]).all()


def test_penalised_fit():
    x = np.sort(rng.random(400))
    y = np.sin(8 * x) + rng.normal(0, 0.2, 400)
    k = sp.Knots.even(20, 0, 1)
    b = sp.design(x, k)
    f = sp.PenalisedFit(b.T @ b, b.T @ y, float(y @ y), 400)
    lam = f.best()
    assert f.reml(lam) >= max(f.reml(lam * s) for s in (0.1, 0.5, 2, 10)) - 1e-9
    fit = b @ f.coefficients(lam)
    assert np.abs(fit - np.sin(8 * x)).mean() < 0.05 and abs(f.variance(lam) - 0.04) < 0.01 and 5 < f.edf(lam) < 20
    # its profiled variance and smoother are those of the mixed model that the penalty stands for
    d = sp.difference(k.dimension)
    z, t = b @ d.T @ np.linalg.inv(d @ d.T), b @ np.c_[np.ones(k.dimension), np.arange(k.dimension)]  # what it shrinks, and what it leaves alone
    v = f.variance(lam) * (np.eye(400) + z @ z.T / lam)
    r = y - t @ np.linalg.solve(t.T @ np.linalg.solve(v, t), t.T @ np.linalg.solve(v, y))
    assert math.isclose(r @ np.linalg.solve(v, r), 398, rel_tol=1e-6)


def test_tensor_fit():
    x, y = rng.random(600), rng.random(600)
    z = np.sin(6 * x) + y + rng.normal(0, 0.1, 600)
    kx = ky = sp.Knots.even(6, 0, 1)
    b = sp.tensor_design(x, kx, y, ky)
    f = sp.TensorFit(b.T @ b, b.T @ z, float(z @ z), 600, kx.dimension, ky.dimension)
    lx, ly = f.best()
    assert ly > 20 * lx  # linear in y, wavy in x
    w = np.linalg.eigvalsh(lx * f.penalties[0] + ly * f.penalties[1])
    assert math.isclose(f.log_pseudo_determinant(lx, ly), np.log(w[4:]).sum(), rel_tol=1e-6)
    assert np.abs(b @ f.coefficients(lx, ly) - np.sin(6 * x) - y).mean() < 0.05


def test_free_knots():
    x = np.sort(rng.random(300))
    truth = np.where(x < 0.4, 0.0, 3.0)
    s = sp.FreeKnots(x, truth + rng.normal(0, 0.2, 300), sp.poisson_prior(3.0), seed=1)
    grid = np.array([0.2, 0.7])
    out = s.run(800, 800, grid)
    assert np.allclose(out["curves"].mean(0), [0, 3], atol=0.15) and 0.02 < np.median(out["sigma2"]) < 0.1
    assert 1 <= out["knots"].mean() < 15 and all(0 < r < 1 for r in out["rates"].values())
    k, c, _ = s.draw()
    t, h = sp.extrema(k, c)
    assert t > 0.4 and h > 2.8
    bad = truth.copy()
    bad[::25] += 8
    robust = sp.FreeKnots(x, bad + rng.normal(0, 0.2, 300), df=3.0, seed=2).run(600, 400, grid)["curves"].mean(0)
    assert np.allclose(robust, [0, 3], atol=0.25)


def test_knot_priors_are_sampled():
    """Without data that tell, the chain visits knot counts as the prior says."""
    s = sp.FreeKnots(np.linspace(0, 1, 4), np.zeros(4), sp.poisson_prior(1.5), seed=3)
    s._fit = lambda knots: (s.prior(len(knots)), None, None, 1.0, None)
    s.now = s._fit([])
    n = []
    for _ in range(40_000):
        s.step()
        n.append(len(s.knots))
    want = [math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(5)]
    assert np.allclose([np.mean(np.array(n) == k) for k in range(5)], want, atol=0.03)
    assert sp.uniform_prior(3)(4) == -math.inf and sp.ebic_prior(10)(0) == 0 and math.isclose(sp.conway_prior(2, 1)(3), sp.poisson_prior(2)(3))


def test_surface():
    x = rng.random((400, 3))
    y = 4 * np.maximum(x[:, 0] - 0.5, 0) + 2 * x[:, 1] * x[:, 0] + rng.normal(0, 0.1, 400)
    s = sp.Surface(x, y, seed=4)
    draws = s.run(1500, 60, 5)
    p = s.predict(draws, x)
    assert 1 - ((p.mean(0) - y) ** 2).mean() / y.var() > 0.95
    main, total = s.sobol(draws)
    assert total.mean(0)[2] < 0.05 < total.mean(0)[1] < total.mean(0)[0] and (main <= total + 1e-9).all()
    e = 1e-6
    g = s.gradient(draws[:3], x[:20])
    step = (s.predict(draws[:3], x[:20] + [e, 0, 0]) - s.predict(draws[:3], x[:20] - [e, 0, 0])) / (2 * e)
    assert np.allclose(g[:, :, 0], step, atol=1e-3) or np.median(np.abs(g[:, :, 0] - step)) < 1e-4
    w, v = s.active_subspace(draws, x)
    assert w[0] > 3 * w[1] and abs(v[2, 0]) < 0.2


def test_sobol_by_integrals():
    terms = [sp.Term(((0, 1, 0.3),)), sp.Term(((0, -1, 0.6), (1, 1, 0.2))), sp.Term(((1, -1, 0.9),))]
    c = np.array([1.5, -2.0, 0.7])
    g = (np.arange(400) + 0.5) / 400
    a, b = np.meshgrid(g, g, indexing="ij")
    pts = np.stack([a.ravel(), b.ravel()], 1)
    f = sum(k * t.column(pts) for k, t in zip(c, terms)).reshape(400, 400)
    main, total = sp.sobol_indices(terms, c, 2)
    assert np.allclose(main, [f.mean(1).var() / f.var(), f.mean(0).var() / f.var()], atol=1e-3)
    assert np.allclose(total, [1 - f.mean(0).var() / f.var(), 1 - f.mean(1).var() / f.var()], atol=1e-3)


def test_summaries():
    s = sp.posterior_summary([1, 2, 3, 4], [1, 1, 1, 1], (0.25, 1.0))
    assert s["mean"] == 2.5 and s["quantiles"] == [1, 4]
    assert math.isclose(sp.mixture_quantile(np.array([0.0, 10.0]), np.array([1.0, 1.0]), 0.5), 5, abs_tol=1e-6) or abs(sp.mixture_quantile(np.array([0.0]), np.array([1.0]), 0.975) - 1.95996) < 1e-4
    x, v = rg.nelder_mead(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, np.zeros(2))
    assert np.allclose(x, [1, -2], atol=1e-3) and v < 1e-5


def test_tables(spark):
    x = rng.random(300)
    rows = [("a" if k % 2 else None, float(u), float(np.sin(6 * u) + rng.normal(0, 0.1))) for k, u in enumerate(x)]
    d = spark.createDataFrame(rows, "s string, x double, y double").repartition(3)
    k = sp.Knots.even(8, 0, 1)
    fits = {r["stratum"]: r for r in rg.penalised_spline(d, "s", "x", "y", k).collect()}
    own = [(u, v) for s, u, v in rows if s == "a"]
    b, v = sp.design(np.array([u for u, _ in own]), k), np.array([v for _, v in own])
    assert np.allclose(fits["a"]["coefficients"], sp.PenalisedFit(b.T @ b, b.T @ v, float(v @ v), len(v)).coefficients(fits["a"]["lambda"])) and set(fits) == {"a", None}
    t = d.withColumn("z", F.col("y") + F.col("x")).withColumn("w", F.rand(1))
    fit, lam, c = rg.tensor_spline(t, "x", "w", "z", k, sp.Knots.even(2, 0, 1))
    assert fit.rows == 300 and len(c) == k.dimension * 5 and len(lam) == 2
    f = rg.free_knots(d.na.fill("b"), "s", "x", "y", [0.5], 100, 100, 2)
    got = {r["stratum"]: r["mean"] for r in rg.summarise(f.withColumn("c", F.col("curve")[0]), ["stratum"], "c").collect()}
    assert f.count() == 400 and abs(got["a"] - math.sin(3)) < 0.2
    s = rg.adaptive_surface(d.na.fill("b").withColumn("u", F.rand(2)), "s", ["x", "u"], "y", 300, 20, 2, 1)
    assert {r["stratum"] for r in s.collect()} == {"a", "b"} and s.agg(F.avg("r2")).first()[0] > 0.8
    with pytest.raises(Exception):
        rg.free_knots(d.na.fill("b"), "s", "x", "y", [0.5], 1, 1, 1, most=10).collect()


def test_exact_changepoints(spark):
    y = [0.1, -0.2, 0.0, 5.1, 4.9, 5.2, 5.0]
    got = sorted(rg.exact_changepoints(spark.createDataFrame([("a", k, v) for k, v in enumerate(y)], "stratum string, seq long, value double"), 0.2).collect(), key=lambda r: r["seq"])
    z = (np.array(y) - np.mean(y)) / np.std(y)

    def marginal(v):
        m, s = len(v), v.sum()
        k = 0.01 + m
        b = 1 + 0.5 * ((v**2).sum() - s * s / k)
        return math.lgamma(1 + m / 2) - (1 + m / 2) * math.log(b) + 0.5 * math.log(0.01 / k) - m / 2 * math.log(2 * math.pi), s / k

    total, change, mean = 0.0, np.zeros(7), np.zeros(7)
    for cuts in itertools.product([0, 1], repeat=6):
        starts = [0, *[i + 1 for i, c in enumerate(cuts) if c], 7]
        w = 0.2 ** sum(cuts) * 0.8 ** (6 - sum(cuts))
        means = np.zeros(7)
        for a, b in zip(starts, starts[1:]):
            lm, mu = marginal(z[a:b])
            w *= math.exp(lm)
            means[a:b] = mu
        total += w
        change[starts[:-1]] += w
        mean += w * means
    assert np.allclose([r["change"] for r in got], change / total) and np.allclose([r["mean"] for r in got], np.mean(y) + np.std(y) * mean / total)
    assert got[3]["change"] == max(r["change"] for r in got[1:])


def test_sensitivity(spark):
    n = 20_000
    a, b = rng.random((n, 2)), rng.random((n, 2))
    f = lambda u: u[:, 0] + 2 * u[:, 1]
    rows = []
    for i in range(2):
        m = a.copy()
        m[:, i] = b[:, i]
        rows += [(i, float(x), float(y), float(z)) for x, y, z in zip(f(a), f(b), f(m))]
    got = {r["input"]: r for r in rg.pick_freeze(spark.createDataFrame(rows, "input int, a double, b double, mixed double")).collect()}
    assert abs(got[0]["first"] - 0.2) < 0.05 and abs(got[1]["total"] - 0.8) < 0.05
    g = spark.createDataFrame([(k, [1.0, 2.0, 0.0]) for k in range(10)], "id long, features array<double>")
    w, scores = rg.activity_scores(g, 1)
    assert np.allclose(w, [5, 0, 0], atol=1e-9) and np.allclose(scores, [1, 4, 0])
    reps = spark.createDataFrame([("a", k, float(k)) for k in range(10)], "s string, draw int, statistic double")
    assert rg.predictive_check(reps, spark.createDataFrame([("a", 7.0)], "s string, statistic double"), ["s"]).first()["p"] == 0.25
