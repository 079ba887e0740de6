import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import distributions as ds
from stratalens.functions import information
from stratalens.operators import monitor, sampling

LAWS = [ds.Normal(mean=1, sd=2), ds.Uniform(low=-1, high=3), ds.Gamma(shape=2.5, rate=1.5), ds.InverseGamma(shape=3, scale=2), ds.Beta(a=2, b=3.5), ds.StudentT(df=4), ds.HalfCauchy(scale=2), ds.Weibull(shape=1.7, scale=2), ds.AsymmetricLaplace(mode=1, scale=0.5, tau=0.3), ds.Truncated(low=-0.5, high=2, of=ds.Normal()), ds.Mixture(laws=(ds.Normal(mean=-2), ds.Normal(mean=3)), weights=(1, 2))]


@pytest.mark.parametrize("law", LAWS, ids=lambda x: type(x).__name__)
def test_density_tail_and_quantile_agree(law):
    p = np.linspace(0.02, 0.98, 25)
    x = law.quantile(p)
    assert np.allclose(law.below(x), p, atol=1e-9) and (np.diff(x) > 0).all()
    for a, b in zip(x[:-1], x[1:]):
        g = np.linspace(a, b, 401)
        assert math.isclose(np.trapezoid(law.density(g), g), law.below(np.array([b]))[0] - law.below(np.array([a]))[0], rel_tol=1e-3)


def test_known_values():
    assert math.isclose(ds.Normal().quantile(0.975)[0], 1.959963985, rel_tol=1e-8)
    assert math.isclose(ds.gamma_lower(1, 2), 1 - math.exp(-2)) and math.isclose(ds.beta_lower(2, 2, 0.5), 0.5)
    assert np.allclose(ds.poisson_binomial(np.array([0.5] * 4)), np.array([1, 4, 6, 4, 1]) / 16)


def test_law_columns(spark):
    d = spark.createDataFrame([(0.1,), (0.9,)], "p double").select("p", ds.Normal().quantile_column(F.col("p")).alias("x"))
    assert all(math.isclose(r["b"], r["p"], rel_tol=1e-9) for r in d.select("p", ds.Normal().below_column(F.col("x")).alias("b")).collect())


def test_information(spark):
    d = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5])], "p array<double>, q array<double>")
    r = d.select(information.shannon(F.col("p")), information.kl(F.col("p"), F.col("q")), information.jensen_shannon(F.col("p"), F.col("q")), information.jensen_shannon(F.col("p"), F.col("p")), information.earth_mover(F.col("p"), F.col("q"))).first()
    assert math.isclose(r[0], math.log(2)) and math.isclose(r[1], math.log(2)) and 0 < r[2] < 1 and r[3] == 0 and math.isclose(r[4], 0.75)


@pytest.mark.parametrize("scheme", ["multinomial", "stratified", "systematic", "residual"])
def test_resampling_is_unbiased(scheme):
    w, rng = np.array([0.1, 0.2, 0.3, 0.4]), np.random.default_rng(0)
    n = sum(np.bincount(sampling.resample(w, scheme, rng), minlength=4) for _ in range(4000)) / 16_000
    assert np.allclose(n, w, atol=0.01)


def test_smc_evidence():
    y = 1.3
    prior = lambda x: -(x[:, 0] ** 2) / 2
    like = lambda x: -((y - x[:, 0]) ** 2) / 2 / 0.25 - 0.5 * math.log(2 * math.pi * 0.25)
    x, z = sampling.smc(lambda r, n: r.normal(size=(n, 1)), like, prior, 3000)
    assert abs(z - (-(y**2) / 2 / 1.25 - 0.5 * math.log(2 * math.pi * 1.25))) < 0.1 and abs(x.mean() - y / 1.25) < 0.06


def test_chains(spark):
    d = sampling.chains(spark, lambda x: -(x[0] ** 2) / 2 - (x[1] - 3) ** 2 / 8, np.array([0.0, 0.0]), draws=1500)
    m = {r["name"]: (r["m"], r["v"]) for r in d.groupBy("name").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()}
    assert abs(m["x0"][0]) < 0.3 and abs(m["x1"][0] - 3) < 0.6 and 0.6 < m["x0"][1] < 1.5
    assert all(r["r_hat"] < 1.2 for r in monitor.split_r_hat(d).collect())


def test_changepoints_are_optimal(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, 12), rng.normal(6, 1, 9), rng.normal(-3, 1, 10)]
    d = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "stratum string, seq long, value double")
    got = sampling.changepoints(d, 8.0).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 11), (12, 20), (21, 30)]
    best = [0.0]
    for t in range(1, 32):
        best.append(min(best[a] + ((x[a:t] - x[a:t].mean()) ** 2).sum() + 8 * (a > 0) for a in range(t)))
    cost = sum(((x[r["first"] : r["last"] + 1] - r["mean"]) ** 2).sum() for r in got) + 8 * (len(got) - 1)
    assert math.isclose(cost, best[31])


def test_gaussian_process_leaves_one_out(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(25)) * 6
    y = np.sin(x) + 0.1 * rng.normal(size=25)
    d = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "stratum string, seq long, x double, y double")
    got = {r["seq"]: r["leave_one_out"] for r in sampling.gaussian_process(d, 1.0, 0.05).collect()}
    k = np.exp(-((x[:, None] - x[None]) ** 2) / 2)
    for i in range(25):
        o = np.arange(25) != i
        want = y.mean() + k[i, o] @ np.linalg.solve(k[np.ix_(o, o)] + 0.05 * np.eye(24), y[o] - y.mean())
        assert math.isclose(got[i], want, abs_tol=1e-8)
