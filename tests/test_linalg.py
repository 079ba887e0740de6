"""Factors, spectra and transforms against NumPy, distributed sums against matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import linalg as la
from stratalens.operators import linalg as ol

rng = np.random.default_rng(0)


def spd(n, half=None):
    a = rng.normal(size=(n, n))
    if half is not None:
        a = np.tril(np.triu(a, -half), half)
        return (a + a.T) / 2 + np.eye(n) * 4 * (half + 1)
    return a @ a.T + n * np.eye(n)


def test_factors():
    a, b = spd(9), rng.normal(size=9)
    f = la.Cholesky(a)
    assert np.allclose(f.solve(b), np.linalg.solve(a, b)) and math.isclose(f.inverse_quadratic_form(b), b @ np.linalg.solve(a, b))
    assert math.isclose(f.log_determinant, np.linalg.slogdet(a)[1]) and 0 < f.relative_pivot <= 1
    d = 1 / np.sqrt(np.diag(a))
    assert math.isclose(f.condition(), np.linalg.cond(d[:, None] * a * d, 1), rel_tol=0.3)
    t = spd(12, 2)
    band = la.BandCholesky.of(t, 2)
    assert np.allclose(band.solve(np.eye(12)), np.linalg.inv(t)) and math.isclose(band.log_determinant, np.linalg.slogdet(t)[1])
    draws = np.array([band.sample_inverse(rng) for _ in range(20_000)])
    assert np.allclose(np.cov(draws.T), np.linalg.inv(t), atol=0.02)
    assert isinstance(la.spd_factor(t, 2), la.BandCholesky) and isinstance(la.spd_factor(a, 5), la.Cholesky)
    with pytest.raises(np.linalg.LinAlgError):
        la.BandCholesky(np.array([[1.0, -1.0], [0.0, 0.0]]))
    with la.counting() as c:
        la.Cholesky(a)
        la.eigen(a)
    assert c == {"cholesky": 1, "eigen": 1}


def test_bordered():
    a = spd(6)
    f = la.BorderedCholesky(a[:5, :5])
    assert math.isclose(f.birth(a[:5, 5], a[5, 5]), np.linalg.det(a) / np.linalg.det(a[:5, :5]))
    f.accept()
    assert np.allclose(f.l @ f.l.T, a)
    for k in (0, 3, 5):
        rest = np.delete(np.delete(a, k, 0), k, 1)
        assert math.isclose(f.death(k), np.linalg.det(rest) / np.linalg.det(a)) and np.allclose(f.next @ f.next.T, rest)
    column = np.delete(a[:, 2], 2) * 0.5
    ratio = f.change(2, column, a[2, 2] * 1.5)
    f.accept()
    new = np.block([[np.delete(np.delete(a, 2, 0), 2, 1), column[:, None]], [column[None], np.array([[a[2, 2] * 1.5]])]])
    assert np.allclose(f.l @ f.l.T, new) and math.isclose(ratio, np.linalg.det(new) / np.linalg.det(a))
    assert f.birth(np.full(6, 1e3), 1.0) <= 0
    with pytest.raises(ValueError):
        f.accept()


def test_low_rank():
    u = rng.normal(size=(8, 3))
    p = la.PivotedCholesky(u @ u.T)
    assert p.rank == 3 and np.allclose(p.loading @ p.loading.T, u @ u.T)
    w = la.DiagonalPlusLowRank(np.arange(1.0, 9), u)
    m, b = np.diag(np.arange(1.0, 9)) + u @ u.T, rng.normal(size=8)
    assert np.allclose(w.solve(b), np.linalg.solve(m, b)) and math.isclose(w.log_determinant, np.linalg.slogdet(m)[1])
    with pytest.raises(np.linalg.LinAlgError):
        la.PivotedCholesky(np.diag([1.0, -1.0]))


def test_spectra():
    a = spd(10)
    w, v = la.jacobi_eigen(a)
    assert np.allclose(w, np.linalg.eigvalsh(a)) and np.allclose(a @ v, v * w) and np.allclose(v.T @ v, np.eye(10))
    assert np.allclose(la.bottom_k(a, 3)[0], w[:3])
    big = spd(60)
    values, x, ok = la.lobpcg(lambda z: big @ z, 60, 4, precondition=lambda r: r / np.diag(big)[:, None])
    assert ok and np.allclose(values, np.linalg.eigvalsh(big)[:4]) and np.allclose(big @ x, x * values, atol=1e-5)
    top, _, ok = la.lobpcg(lambda z: big @ z, 60, 2, largest=True)
    assert ok and np.allclose(top, np.linalg.eigvalsh(big)[::-1][:2])
    lap = np.diag(np.r_[1, np.full(18, 2), 1]) - np.diag(np.ones(19), 1) - np.diag(np.ones(19), -1)
    null = np.full((20, 1), 1 / math.sqrt(20))
    assert math.isclose(la.lobpcg(lambda z: lap @ z, 20, 1, constraints=null)[0][0], 2 - 2 * math.cos(math.pi / 20), abs_tol=1e-8)
    for shape in ((7, 4), (4, 7)):
        m = rng.normal(size=shape)
        u, s, vt = la.thin_svd(m)
        assert np.allclose(u * s @ vt, m) and np.allclose(s, np.linalg.svd(m, compute_uv=False))


def test_subspaces_and_functions():
    a = np.eye(4)[:, :2]
    b = np.c_[np.array([math.cos(0.3), 0, math.sin(0.3), 0]), np.eye(4)[:, 1]]
    assert np.allclose(la.principal_angles(a, b), [0, 0.3]) and np.allclose(la.principal_angles(a, np.eye(4)[:, 2:]), [math.pi / 2] * 2)
    q = la.orthonormal(np.c_[a, a[:, :1], rng.normal(size=(4, 1))])
    assert q.shape == (4, 3) and np.allclose(q.T @ q, np.eye(3))
    m = spd(5)
    assert np.allclose(la.symmetric_function(m, np.sqrt) @ la.symmetric_function(m, np.sqrt), m)
    s = rng.normal(size=(4, 4)) * 0.4
    s = s - s.T
    r = la.rotation(s)
    assert np.allclose(r @ r.T, np.eye(4)) and np.allclose(la.rotation_log(r), s)
    with pytest.raises(ValueError):
        la.rotation_log(np.diag([-1.0, -1.0]))


def test_sums_and_transforms():
    x = rng.normal(size=1001)
    assert math.isclose(la.pairwise_sum(x), math.fsum(x), abs_tol=1e-12) and la.pairwise_sum([]) == 0 and math.isclose(la.pairwise_dot(x, x), x @ x)
    y = rng.normal(size=64) + 1j * rng.normal(size=64)
    assert np.allclose(la.fft(y), np.fft.fft(y)) and np.allclose(la.fft(la.fft(y), True), y)
    z = rng.normal(size=(4, 8, 2))
    assert np.allclose(la.fft_nd(z), np.fft.fftn(z)) and np.allclose(la.fft_nd(la.fft_nd(z), True), z)
    with pytest.raises(ValueError):
        la.fft(np.zeros(6))
    a, h = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    kr = np.stack([np.kron(a[:, j], h[:, j]) for j in range(3)], 1)
    assert np.allclose(la.khatri_rao_gram(a, h), kr.T @ kr)
    f = np.stack([np.kron(p, q) for p, q in zip(a, rng.normal(size=(5, 2)))])
    g = np.stack([np.kron(p, q) for p, q in zip(a, h[:1].repeat(5, 0))])
    assert np.allclose(la.face_splitting_gram(a, h[:1].repeat(5, 0)), g.T @ g) and f.shape == (5, 6)


@pytest.mark.parametrize("symmetric", [False, True])
def test_ica(symmetric):
    s = np.c_[np.sign(rng.normal(size=4000)), rng.laplace(size=4000)]
    got, _ = la.ica(s @ np.array([[1, 0.4], [0.6, 1]]), 2, symmetric)
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert sorted(c.argmax(1)) == [0, 1] and c.max(1).min() > 0.97


def test_online_distance():
    x = rng.normal(size=(200, 3)) * [1, 5, 10]
    a, b = la.OnlineMahalanobis(3), la.OnlineMahalanobis(3)
    for r in x[:80]:
        a.update(r)
    for r in x[80:]:
        b.update(r)
    a.merge(b)
    assert np.allclose(a.variance, x.var(0, ddof=1)) and math.isclose(a.distance(x[0]), math.sqrt((((x[0] - x.mean(0)) ** 2) / x.var(0, ddof=1)).sum()))


def test_tables(spark):
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    p = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>").repartition(4)
    assert np.allclose(ol.dense(ol.gram(p)), x.T @ x)
    s, v = ol.thin_svd(p, 3)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:3])
    fit = ol.pca(p, 5, whiten=True)
    z = np.array([r["features"] for r in fit["table"].collect()])
    assert np.allclose(np.cov(z.T, ddof=0), np.eye(5), atol=1e-6) and math.isclose(fit["share"].sum(), 1)
    d = {r["id"]: r["distance"] for r in ol.mahalanobis(p).collect()}
    c = x - x.mean(0)
    assert math.isclose(d[7], math.sqrt(c[7] @ np.linalg.solve(np.cov(x.T, ddof=0), c[7])), rel_tol=1e-6)
    a = [(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)]
    m = spark.createDataFrame(a, "i int, j int, v double")
    assert {tuple(r) for r in ol.product(m, m).collect()} == {(0, 0, 4.0), (0, 1, 5.0), (1, 1, 9.0)}
    t = spark.createDataFrame([("a", k, float(k % 3)) for k in range(10)], "stratum string, t long, x double")
    got = {r["k"]: r["power"] for r in ol.power_spectrum(t, 16).collect()}
    assert np.allclose([got[k] for k in range(16)], np.abs(np.fft.fft([k % 3 for k in range(10)], 16)) ** 2)
    two = p.withColumn("b", F.slice("features", 1, 2))
    assert np.allclose(ol.dense(ol.face_splitting(two, "features", "b")), la.face_splitting_gram(x, x[:, :2]))
