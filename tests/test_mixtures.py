"""Merged components against densities and entropies counted plainly."""

import math

import numpy as np

from stratalens.operators import cluster
from stratalens.operators import mixtures as mx


def model():
    """Two clusters: the first in two overlapping parts."""
    means = np.array([[0.0, 0.0], [0.8, 0.0], [8.0, 0.0]])
    return {"weights": np.array([0.3, 0.3, 0.4]), "means": means, "covariances": np.stack([np.eye(2)] * 3), "ridge": 0.0}


def test_modes_and_overlap():
    m = model()
    assert mx.merge_by_mode(m).tolist() == mx.merge_by_overlap(m).tolist() == [0, 0, 1]
    top = mx.ascend(m, np.array([[0.1, 1.0], [7.0, -1.0]]))
    grid = np.stack(np.meshgrid(np.linspace(-1, 9, 401), np.linspace(-1, 1, 81), indexing="ij"), -1).reshape(-1, 2)
    d = np.exp(cluster.log_density(grid, m["weights"], m["means"], [np.eye(2)] * 3)).sum(1)
    left = grid[:, 0] < 4
    for t, side in zip(top, (left, ~left)):
        assert np.abs(grid[side][d[side].argmax()] - t).max() < 0.03


def test_entropy(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (200, 2)) + [0.4, 0], rng.normal(0, 1, (150, 2)) + [8, 0]]
    pts = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>")
    rows = cluster.responsibilities(pts, model()).cache()
    p = np.stack([r["p"] for r in sorted(rows.collect(), key=lambda r: r["id"])])
    h = lambda q: float(-(q * np.log(np.maximum(q, 1e-300))).sum())
    g = mx.entropy_gains(rows, np.arange(3))
    assert math.isclose(g[0, 1], h(p) - h(np.c_[p[:, 0] + p[:, 1], p[:, 2]]), rel_tol=1e-9)
    groups, gains = mx.merge_by_entropy(rows, 3, 2)
    assert groups.tolist() == [0, 0, 1] and len(gains) == 1 and gains[0] > 10
    out = {r["id"]: r for r in mx.merged(rows, groups).collect()}
    plain = np.c_[p[:, 0] + p[:, 1], p[:, 2]].argmax(1)
    assert sum(plain == (np.arange(350) >= 200)) > 345 and all(out[k]["label"] == plain[k] for k in range(350)) and math.isclose(sum(out[3]["p"]), 1)
    for name, f in mx.STRATEGIES.items():
        assert f(model(), rows, 2).tolist() == [0, 0, 1], name
    known = spark.createDataFrame([(0, 2)], "id long, label int")
    bent = {r["id"]: r for r in mx.annealed(rows, known, 200.0).collect()}
    assert bent[0]["label"] == 2 and np.allclose(bent[1]["p"], p[1])
