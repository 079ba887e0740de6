import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph, spectral
from stratalens.plans.compiler import GraphConfig, compile_graph, repair
from stratalens.sources import synthetic


def test_compiler_repairs_and_reports(spark):
    p = synthetic.spatial_blobs(spark, 3, 40, spread=0.1)
    g = compile_graph(p, GraphConfig(k=5))
    assert g.config.repair and g.diagnostics["coverage"] < 0.95 and g.diagnostics["bridges"] == 2
    assert graph.connectivity(g.edges.select("src", "dst", "d"), p).first()["components"] == 1
    assert {"w", "log_w"} <= set(g.edges.columns) and g.scale > 0 and g.log
    whole = compile_graph(p.where("label = 0"), GraphConfig(k=8, mutual=False, repair=False, proximity=True))
    assert "lmp" in whole.edges.columns and not whole.config.repair
    with pytest.raises(ValueError):
        compile_graph(p, GraphConfig(k=5, epsilon=1.0))


def test_bridges_are_minimal(spark):
    x = np.array([[0, 0], [1, 0], [10, 0], [11, 0], [10.5, 30]], float)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, d double")
    _, b = repair(p, e)
    assert {(r["src"], r["dst"]) for r in b.collect()} == {(1, 2), (2, 4)} and b.where("src = 1").first()["d"] == 9


def test_path_refinement(spark):
    p = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0.0, 1.0, 2.0])], "id long, features array<double>")
    g = compile_graph(p, GraphConfig(k=2, path_bound=10.0, repair=False, scale=1.0))
    assert {(r["src"], r["dst"]): r["d"] for r in g.edges.collect()} == {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 2.0}


def test_spectra(spark):
    n = 12
    ring = spark.createDataFrame([(0, i, (i + 1) % n, 1.0) for i in range(n)], "group long, src long, dst long, w double")
    assert np.isclose(spectral.algebraic_connectivity(ring).first()["connectivity"], 2 - 2 * np.cos(2 * np.pi / n))
    assert all(np.isclose(r["resistance"], (n - 1) / n) for r in spectral.effective_resistance(ring).collect())


def test_smoothing(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 0.5)], "src long, dst long, w double")
    b = np.array([1.0, -2.0, 0.5, 3.0])
    s = spark.createDataFrame(list(enumerate(b.tolist())), "id long, value double")
    lap = np.array([[1, -1, 0, 0], [-1, 3, -2, 0], [0, -2, 2.5, -0.5], [0, 0, -0.5, 0.5]])
    got = {r["id"]: r["value"] for r in spectral.smooth(e, s, 0.4, tolerance=1e-10).collect()}
    assert np.allclose([got[i] for i in range(4)], np.linalg.solve(np.eye(4) + 0.4 * lap, b), atol=1e-6)


def test_connectivity_of_large_groups(spark):
    n = spectral.DENSE + 500
    star = spark.range(1, n).selectExpr("CAST(1 AS LONG) AS group", "CAST(0 AS LONG) AS src", "id AS dst", "2.0D AS w")
    apart = star.selectExpr("CAST(2 AS LONG) AS group", "src + dst % 2 AS src", "dst + 2 AS dst", "w")
    got = {r["group"]: r["connectivity"] for r in spectral.algebraic_connectivity(star.unionByName(apart)).collect()}
    assert np.isclose(got[1], 2.0, rtol=1e-9) and got[2] == 0
    rng = np.random.default_rng(0)
    a, b = np.r_[np.arange(399), rng.integers(0, 400, 800)], np.r_[np.arange(1, 400), rng.integers(0, 400, 800)]
    w = rng.random(len(a))
    lap = np.zeros((400, 400))
    for i, j, x in zip(a, b, w, strict=True):
        lap[[i, j, i, j], [i, j, j, i]] += np.array([x, x, -x, -x]) * (i != j)
    assert np.isclose(spectral._second_value(a[a != b], b[a != b], w[a != b], 400), np.linalg.eigvalsh(lap)[1], rtol=1e-9)
