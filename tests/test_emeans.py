"""Decayed mini-batch means: Lloyd's corner, blobs, revival, laws."""

import math

import numpy as np
import pytest

from stratalens.operators import emeans as em

rng = np.random.default_rng(0)


def table(spark, x):
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>").repartition(3)


def test_lloyd_is_a_corner(spark):
    """One batch an epoch and a step of 1 are Lloyd's rounds."""
    x = rng.normal(0, 1, (120, 2))
    start = x[:4].copy()
    fit = em.cluster(table(spark, x), em.Settings(4, 3, batch=120, peak=1.0, cosine=False, revive_every=0, final="fast"), start)
    c = start
    for _ in range(3):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[a == k].mean(0) for k in range(4)])
    assert np.allclose(fit.centroids, c) and math.isclose(fit.distortion, ((x[:, None] - c[None]) ** 2).sum(2).min(1).mean())
    assert len(fit.trace) == 3 and fit.trace[0][1] >= fit.trace[2][1] >= fit.distortion


@pytest.mark.parametrize("final", ["last_epoch", "slow"])
def test_blobs_and_revival(spark, final):
    means = np.array([[0, 0], [10, 0], [0, 10.0]])
    x = np.r_[tuple(rng.normal(0, 0.5, (100, 2)) + m for m in means)]
    p = table(spark, x)
    start = np.array([[0.0, 0], [0.1, 0], [50.0, 50]])  # two in one blob, one far off
    fit = em.cluster(p, em.Settings(3, 6, batch=64, peak=0.5, revive_every=2, final=final, slow=3.0, seed=1), start)
    near = np.sqrt(((fit.centroids[:, None] - means[None]) ** 2).sum(2))
    assert (near.min(0) < (0.5 if final == "last_epoch" else 3.5)).all() and sum(r for *_, r in fit.trace) >= 1
    assert fit.labels.count() == 300 and fit.outside
    again = em.cluster(p.repartition(5), em.Settings(3, 6, batch=64, peak=0.5, revive_every=2, final=final, slow=3.0, seed=1), start)
    assert np.allclose(again.centroids, fit.centroids)


def test_laws():
    assert em.batch_size(100, 2, 1) <= 100 and em.batch_size(10**6, 1000, 10) in (2**k for k in range(30))
    raw = 0.035 * 1000**0.13 * (3 * 10**6) ** 0.88 * 10**0.81 / 8
    assert em.batch_size(3 * 10**6, 1000, 10) == 2 ** round(math.log2(raw))
    assert em.peak_step(10**6, 2, 1, 10**6) == 1.0 and 0 < em.peak_step(10**7, 5000, 10, 4096) < 1
    assert em.step_at(0, 10, 0.5) == 0.5 and math.isclose(em.step_at(10, 10, 0.5), 0.05) and em.step_at(7, 10, 0.5, cosine=False) == 0.5
    assert em.extrapolations(10**6, 300, 10, 4096) == [] and em.extrapolations(100, 2, 30, 100) == ["n", "k", "batch", "batch", "epochs"]


def test_bounds(spark):
    with pytest.raises(ValueError):
        em.cluster(table(spark, np.zeros((3, 2))), em.Settings(4, 1))
