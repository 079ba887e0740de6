"""Mapper's parts, and manifolds against their own geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import manifolds as mf
from stratalens.operators import mapper
from stratalens.operators.topology import nerve, uniform_cover

rng = np.random.default_rng(0)


def frame_of(n, k):
    return np.linalg.qr(rng.standard_normal((n, k)))[0]


def hyper():
    v = rng.standard_normal(3)
    return np.r_[math.sqrt(1 + v @ v), v]


SPACES = [(mf.Euclidean(), lambda: rng.standard_normal(3)), (mf.Sphere(), lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(4))), (mf.Hyperboloid(), hyper), (mf.Ball(), lambda: rng.uniform(-0.4, 0.4, 3)), (mf.Scaled(mf.Sphere(), 2.0), lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(4)))]


@pytest.mark.parametrize("space, point", SPACES, ids=range(5))
def test_spaces(space, point):
    for _ in range(10):
        p, q = point(), point()
        v = space.log(p, q)
        assert np.allclose(space.exp(p, v), q, atol=1e-8) and math.isclose(space.distance(p, q), space.distance(q, p), rel_tol=1e-6)
        half = space.exp(p, v / 2)
        assert math.isclose(space.distance(p, half), space.distance(p, q) / 2, rel_tol=1e-6)
    pts = [point() for _ in range(5)]
    m, _ = mf.irls(space, pts, "l2")
    assert np.allclose(sum(space.log(m, q) for q in pts), 0, atol=1e-6)


def test_frames_and_products():
    p = frame_of(6, 2)
    g = mf.Grassmann()
    v = rng.standard_normal((6, 2)) * 0.3
    v -= p @ (p.T @ v)
    q = g.exp(p, v)
    assert np.allclose(np.abs(np.linalg.svd(q.T @ g.exp(p, g.log(p, q)), compute_uv=False)), 1) and math.isclose(g.distance(p, q), g.norm(p, v), rel_tol=1e-6)
    s = mf.Stiefel()
    t = s.project(p, rng.standard_normal((6, 2)) * 0.3)
    r = s.exp(p, t)
    assert np.allclose(r.T @ r, np.eye(2)) and np.allclose(s.log(p, r), t, atol=1e-6)
    both = mf.Product(mf.Euclidean(), mf.Sphere())
    a, b = (np.zeros(2), np.eye(3)[0]), (np.array([3.0, 0]), np.eye(3)[1])
    assert math.isclose(both.distance(a, b), math.hypot(3, math.pi / 2))


def test_estimators():
    pts = [np.array([0.0, 0]), np.array([1.0, 0]), np.array([0.0, 1]), np.array([50.0, 50])]
    med, w = mf.irls(mf.Euclidean(), pts, "l1", rounds=5000)
    grid = min((sum(np.linalg.norm(np.array([x, y]) - p) for p in pts), x, y) for x in np.linspace(0, 1, 101) for y in np.linspace(0, 1, 101))
    assert abs(med[0] - grid[1]) < 0.02 and abs(med[1] - grid[2]) < 0.02 and w[3] < 0.1
    x = rng.standard_normal((5000, 3))
    assert np.allclose(mf.scatter(mf.Euclidean(), list(x), np.zeros(3)), np.eye(3), atol=0.1) and math.isclose(np.trace(mf.scatter(mf.Euclidean(), list(x[:50]), np.zeros(3), shape=True)), 1)
    assert math.isclose(np.linalg.norm(x, axis=1).mean() * mf.consistency(3), 1, rel_tol=0.02)
    for f, d in ((mf.sphere_second_moment, 2), (mf.hyperbolic_second_moment, 3)):
        assert math.isclose(mf.match_beta(f, f(2.5, d), d), 2.5, rel_tol=1e-3)
    assert math.isclose(mf.heat_bandwidth(0.5), 1) and math.isclose(mf.sphere_second_moment(200.0, 2), 2 / 400, rel_tol=0.02)
    data = rng.standard_normal((200, 4)) * [1, 1, 1, 3]
    data[:, 0] = np.sign(data[:, 0]) * 5 + 0.1 * data[:, 0]
    p, v = mf.anneal_subspace(data, 1, lambda z: float(np.mean(z**4) / np.mean(z**2) ** 2), 600)
    assert abs(p[0, 0]) > 0.9 and v < 1.3
    y = rng.standard_normal((60, 5))
    assert mf.largest_mean_factor(y, rng.standard_normal((60, 5))) < 0 < mf.largest_mean_factor(y, rng.standard_normal((60, 5)) + [3, 0, 0, 0, 0])


def ring(spark, n=120):
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return spark.createDataFrame([(k, [float(math.cos(t)), float(math.sin(t))]) for k, t in enumerate(a)], "id long, features array<double>")


def test_mapper_on_a_ring(spark):
    p = ring(spark)
    lens = mapper.coordinate(p)
    cover = uniform_cover(lens, 6, 0.4)
    for clusterer in (mapper.by_density(3, 3), mapper.by_kmeans(2)):
        m = mapper.build(p, cover, clusterer)
        r = mapper.report(m, 120).first().asDict()
        assert r["coverage"] == 1 and r["components"] <= 2 and r["edges"] == nerve(m).count()
    m = mapper.build(p, cover, mapper.by_density(3, 3))
    r = mapper.report(m, 120).first().asDict()
    assert r["cycles"] == r["components"] == 1 and mapper.warnings(r) == []
    e = spark.createDataFrame([(k, (k + 1) % 120) for k in range(120)], "src long, dst long")
    on = mapper.build_on_graph(e, cover)
    assert mapper.report(on, 120).first()["cycles"] == 1
    dims = [r["dimension"] for r in mapper.intrinsic_dimension(m, p).collect()]
    assert 1 <= min(dims) and max(dims) < 2.01
    assert mapper.colour(m, lens, "value").count() == m.select("node").distinct().count()
    assert len(mapper.warnings({"coverage": 0.5, "nodes": 10, "singles": 9, "components": 8, "edges": 40})) == 4


def test_lenses(spark):
    p = ring(spark, 40)
    assert {round(r["value"], 9) for r in mapper.norm(p).collect()} == {1.0}
    assert mapper.first_component(p).count() == 40
    half = p.select("id", F.transform("features", lambda x: x / 2).alias("features"))
    assert {round(r["value"], 6) for r in mapper.poincare_radius(half).collect()} == {round(2 * math.atanh(0.5), 6)}
    assert mapper.local_density(half, 2).count() == 40
    path = spark.createDataFrame([(k, k + 1, 1.0) for k in range(9)], "src long, dst long, w double")
    nodes = spark.range(10)
    f = {r["id"]: r["value"] for r in mapper.fiedler(path, nodes).collect()}
    want = np.cos(np.pi * (np.arange(10) + 0.5) / 10)
    got = np.array([f[k] for k in range(10)])
    assert np.allclose(np.abs(got / np.linalg.norm(got)), np.abs(want / np.linalg.norm(want)), atol=1e-4)
    assert {r["id"]: r["value"] for r in mapper.hops(path.select("src", "dst"), 0, 3).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r["value"] for r in mapper.degree(path, nodes).collect()} == {1.0, 2.0}
    two = mapper.product_cover([mapper.coordinate(p, 0), mapper.coordinate(p, 1)], 3, 0.2)
    assert two.select("id").distinct().count() == 40 and two.agg(F.max("bin")).first()[0] <= 8
    assert mapper.by_graph([(1, 2), (5, 6)])(np.array([1, 2, 5, 9])).tolist() == [0, 0, 1, 2]


def test_frames(spark):
    from stratalens.operators.topology import linkage_clusters

    x = [(k, [0.1 * k, 0.0]) for k in range(10)] + [(20 + k, [0.1 * k, 2.0]) for k in range(10)]
    p = spark.createDataFrame(x, "id long, features array<double>")
    f = mapper.frames(p, mapper.coordinate(p), 0.4, linkage_clusters, [0.3, 1.0, 3.0], 3)
    assert sorted(tuple(r) for r in mapper.component_bars(f).collect()) == [(0.3, 3.0), (0.3, math.inf)]


def test_density_of_a_cell():
    own = np.random.default_rng(1)
    label = mapper.by_density()(np.r_[own.normal(0, 0.1, (20, 2)), own.normal(5, 0.1, (20, 2))])
    a, b = (np.bincount(half).argmax() for half in (label[:20], label[20:]))
    assert a != b and (label[:20] == a).sum() >= 15 and (label[20:] == b).sum() >= 15 and not (label[:20] == b).any() and not (label[20:] == a).any()
    assert (mapper.by_density()(np.ones((12, 2))) >= 0).all()
