"""Scores, metrics and kernels by name."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import metrics
from stratalens.operators import cluster, evaluate


def test_scores_by_name(spark):
    x = np.r_[np.random.default_rng(0).normal(0, 0.3, (40, 2)), np.random.default_rng(1).normal(9, 0.3, (40, 2)), [[100.0, 4.5]]]
    p = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>")
    truth = spark.createDataFrame([(k, k // 40) for k in range(81)], "id long, label long")
    labels, s = cluster.density_session(p, truth)
    assert s["clusters"] == 2 and math.isclose(s["coverage"], 80 / 81) and s["adjusted_rand"] == 1.0
    _, dropped = cluster.density_session(p, truth, cluster.Density(noise="drop"))
    assert dropped["purity"] == 1.0
    edges = spark.createDataFrame([(0, 1, 1.0), (40, 41, 1.0), (1, 40, 0.5)], "src long, dst long, w double")
    assert math.isclose(evaluate.score("coverage", labels, edges=edges), 2 / 2.5)
    assert evaluate.score("silhouette", labels, points=p) > 0.9 and evaluate.score("davies_bouldin", labels, points=p) < 0.2
    with pytest.raises(ValueError):
        evaluate.score("beauty", labels)


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "chebyshev", "canberra", "cosine", "angular", "minkowski:p=0.5", "minkowski:p=3"])
def test_properties_hold(spark, name):
    rng = np.random.default_rng(2)
    rows = [(*(v.tolist() for v in rng.uniform(0.1, 2, (3, 4))),) for _ in range(200)]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>, c array<double>")
    m, p = metrics.metric(name), metrics.properties(name)
    grow = lambda c: F.transform(c, lambda x: x * 3)
    move = lambda c: F.transform(c, lambda x: x + 5)
    got = np.array(d.select(m(F.col("a"), F.col("b")), m(F.col("b"), F.col("c")), m(F.col("a"), F.col("c")), m(grow(F.col("a")), grow(F.col("b"))), m(move(F.col("a")), move(F.col("b")))).collect(), float)
    short = (got[:, 2] <= got[:, 0] + got[:, 1] + 1e-9).all()
    assert short or not p.triangle
    if name == "minkowski:p=3":
        assert p.triangle
    if p.scale_free:
        assert np.allclose(got[:, 3], got[:, 0])
    if p.shift_free:
        assert np.allclose(got[:, 4], got[:, 0])
    assert (got <= p.most + 1e-9).all()


def test_kernel_facts(spark):
    d = spark.createDataFrame([(x / 100,) for x in range(1, 400)], "d double")
    for name, k in metrics.KERNEL_FACTS.items():
        rows = d.select(metrics.KERNELS[name](F.col("d"), F.lit(1.0)).alias("w"), k.log(F.col("d"), F.lit(1.0)).alias("l")).collect()
        w = np.array([r["w"] for r in rows])
        assert np.abs(np.diff(w)).max() / 0.01 <= k.slope + 1e-6 and (w[-1] == 0) == k.compact
        assert np.allclose(w[w > 0], np.exp([r["l"] for r in rows if r["w"] > 0]))
