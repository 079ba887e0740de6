import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from stratalens.operators import geometry as g


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def test_means_and_medians(spark):
    x = np.r_[np.random.default_rng(0).normal(size=(60, 2)), [[50.0, 50.0]]]
    assert np.allclose(g.location(frame(spark, x))[0], x.mean(0))
    m = g.location(frame(spark, x), median=True)[0]
    at = lambda p: np.linalg.norm(x - p, axis=1).sum()
    assert all(at(m) <= at(m + d) + 1e-9 for d in 0.01 * np.random.default_rng(1).normal(size=(50, 2))) and np.linalg.norm(m) < 1


def test_curved_means_balance(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(50, 3)) * 0.3 + [1, 0, 0]
    s /= np.linalg.norm(s, axis=1)[:, None]
    b = rng.uniform(-0.5, 0.5, size=(50, 2))
    for name, x in (("sphere", s), ("ball", b)):
        p, _ = g.location(frame(spark, x), name)
        assert np.linalg.norm(g.MANIFOLDS[name].log(p, x).mean(0)) < 1e-8
    v = g._ball_log(b[0], b)
    assert np.allclose(g._ball_exp(b[0], v[7]), b[7])


def test_block_components_resist_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [5, 1, 0.5]
    x[:2] = [[0, 0, 900], [0, 0, -900]]
    v = g.block_components(frame(spark, x), 1)
    assert abs(v[0, 0]) > 0.95


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for n in range(1, 7):
        c = rng.random((n, n))
        got = g.assignment(c)
        assert math.isclose(c[np.arange(n), got].sum(), min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_diagram_distances(spark):
    a, b = np.array([[0, 4.0], [1, 2]]), np.array([[0, 5.0]])
    assert g.wasserstein(a, b) == 1.5 and g.bottleneck(a, b) == 1.0 and g.wasserstein(a, a) == 0 and g.wasserstein(a, np.zeros((0, 2))) == 2.5
    assert g.sliced(a, a) == 0 < g.sliced(a, b) and g.essential_distance(np.array([0.0]), np.array([])) == math.inf
    rows = [(0, 0, 0.0, 4.0), (0, 0, 1.0, 2.0), (0, 0, 0.0, math.inf), (1, 0, 0.0, 5.0), (1, 0, 0.5, math.inf), (2, 1, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "group long, dim int, birth double, death double")
    assert [tuple(r) for r in g.diagram_distances(d).collect()] == [(0, 1, 0, 2.0)]
    assert g.diagram_distances(d, "bottleneck").where(F.col("distance") == 1.5).count() == 1


def test_distances_of_many_bars(spark):
    rng = np.random.default_rng(0)
    for flat in (0, 1):
        for _ in range(30):
            a, b = (np.round(np.cumsum(rng.random((int(rng.integers(0, 9)), 2)) * [flat, 1], 1), 1) for _ in "ab")
            for p in (1.0, 2.0):
                c = g._costs(a, b) ** p
                want = c[np.arange(len(c)), g.assignment(c)].sum() ** (1 / p)
                small = min((sum(c[i, k] for i, k in enumerate(x)) for x in itertools.permutations(range(len(c)))), default=0.0) if len(c) < 7 else want**p
                assert np.isclose(want**p, small) and np.isclose(g.wasserstein(a, b, p), want)
    # in units of a half, shifted by a half: every bar moves, none is worth its way to the diagonal
    rows = [(k, 0, 0.0, 100.0 + i + k / 2) for k in (0, 1) for i in range(600)] + [(k, 1, float(i), i + 0.25 + k / 4) for k in (0, 1) for i in range(600)]
    d = spark.createDataFrame(rows, "group long, dim int, birth double, death double")
    assert sorted(tuple(r) for r in g.diagram_distances(d).collect()) == [(0, 1, 0, 300.0), (0, 1, 1, 150.0)]
