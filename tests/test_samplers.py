"""Samplers against known laws, laws against integrals."""

import itertools
import math

import numpy as np
import pytest

from stratalens.functions import laws, linalg
from stratalens.functions import samplers as sm


def normal(x):
    return -0.5 * float(np.sum(np.square(x)))


def test_blocks():
    rng = np.random.default_rng(0)
    x, out = 0.0, []
    for _ in range(6000):
        x = sm.slice_step(x, normal, 1.5, rng)
        out.append(x)
    assert abs(np.mean(out)) < 0.1 and abs(np.var(out) - 1) < 0.12
    y, at, out = np.zeros(2), 0.0, []
    for _ in range(12_000):
        y, at, _ = sm.random_walk(y, at, normal, 1.5, rng)
        out.append(y)
    assert np.allclose(np.cov(np.array(out).T), np.eye(2), atol=0.15)
    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    z, moved = np.array([3.0, -2.0]), 0
    for _ in range(300):
        z, ok = sm.newton_step(z, lambda v: -0.5 * v @ a @ v, lambda v: -a @ v, lambda v: -a, rng)
        moved += ok
    assert moved == 300  # the proposal is the law itself
    f = linalg.Cholesky(a)
    d = np.array([sm.gaussian_conditional(f, np.ones(2), rng) for _ in range(20_000)])
    assert np.allclose(np.cov(d.T), np.linalg.inv(a), atol=0.03) and np.allclose(d.mean(0), 1, atol=0.03)
    v = np.array([sm.normal_variance(3, 2, 10, 8, rng) for _ in range(20_000)])
    assert abs(v.mean() - 6 / 7) < 0.02


def test_scan_resumes():
    blocks = [("a", lambda s, r: (s + r.standard_normal(), True)), ("b", lambda s, r: (s, r.random() < 0.5))]
    s = sm.Scan(blocks, 0.0, 3)
    for _ in range(10):
        s.step()
    kept = s.snapshot()
    for _ in range(5):
        s.step()
    end = s.state
    s.restore(kept)
    for _ in range(5):
        s.step()
    assert s.state == end and s.counts["a"] == (15, 15)


def walk(scale):
    return ("walk", lambda s: 1.0, lambda s, r: (s + scale * r.standard_normal(), 0.0))


def two_humps(s):
    return float(np.logaddexp(-0.5 * ((s - 4) / 0.3) ** 2, -0.5 * ((s + 4) / 0.3) ** 2))


def ladder(seed=0):
    betas = [0.0, 0.01, 0.03, 0.1, 0.3, 1.0]
    prior = lambda s: -0.5 * (s / 5) ** 2
    return sm.Ladder([sm.Chain([walk(3.0 if b < 0.2 else 0.5)], two_humps, prior, 4.0, b, seed + k) for k, b in enumerate(betas)], seed)


def test_ladder_and_evidence():
    l = ladder()
    out = []
    for i in range(8000):
        l.step(3, i >= 500)
        out.append(l.chains[-1].state)
    out = np.array(out[500:])
    assert 0.35 < (out > 0).mean() < 0.65 and 0 < l.rejection.max() < 1
    truth = math.log(2 * 0.3 / math.hypot(5, 0.3)) - 0.5 * 16 / (25 + 0.09)
    s, err = sm.stepping_stone(l.betas, [np.array(x) for x in l.levels])
    assert abs(s - truth) < 0.25 and err < 0.2
    fine = sm.path_sampling(np.linspace(0, 1, 401), [np.array([b]) for b in np.linspace(0, 1, 401)])
    assert math.isclose(fine, 0.5)
    b = sm.equalised(l.betas, l.rejection)
    assert b[0] == 0 and b[-1] == 1 and (np.diff(b) > 0).all() and sm.recommended_levels(l.rejection) >= 2
    assert math.isclose(sm.round_trip_rate(np.zeros(4)), 0.5) and math.isclose(sm.barrier([0.2, 0.3]), 0.5)
    nodes = np.linspace(min(map(min, l.levels)) - 1, 0.01, 600)
    _, z = sm.wham(l.betas, [np.array(x) for x in l.levels], nodes)
    assert abs(z[-1] - truth) < 0.5


def test_reversible_jumps_follow_the_prior():
    """Sets of points in [0, 1] with a Poisson count: births and deaths alone."""
    def birth(s, r):
        return [*s, r.random()], math.log(1.0)

    def death(s, r):
        return (None if not s else (s[:-1], 0.0))

    prior = lambda s: len(s) * math.log(2.0) - math.lgamma(len(s) + 1)
    c = sm.Chain([("birth", lambda s: 1.0, birth), ("death", lambda s: 1.0, death)], lambda s: 0.0, prior, [], seed=1)
    n = []
    for _ in range(40_000):
        c.step()
        n.append(len(c.state))
    assert np.allclose([np.mean(np.array(n) == k) for k in range(5)], [math.exp(-2) * 2**k / math.factorial(k) for k in range(5)], atol=0.02)
    kept = c.snapshot()
    c.step()
    after = c.state
    c.restore(kept)
    c.step()
    assert c.state == after and c.stats["birth"][0] > 0


def test_flat_histogram():
    c = sm.Chain([walk(2.5)], two_humps, lambda s: -0.5 * (s / 5) ** 2, 4.0, seed=5)
    m = sm.Multicanonical(c, sm.Weights(np.linspace(-60, 0, 25), np.zeros(25), 0.0))
    for _ in range(30_000):
        m.step(learn=True)
    m.visits[:] = 0
    levels, states = [], []
    for _ in range(30_000):
        levels.append(m.step())
        states.append(m.chain.state)
    levels = np.array(levels)
    assert sm.round_trips(levels, -50, -1) > 10 and m.flatness() > 0.02
    logw = np.array([m.weights(x) for x in levels])
    w, ess, mean = sm.reweight(levels, logw, 1.0, np.abs(states))
    assert abs(mean - 4) < 0.1 and ess > 100
    truth = math.log(2 * 0.3 / math.hypot(5, 0.3)) - 0.5 * 16 / (25 + 0.09)
    assert abs(sm.log_evidence_curve(levels, logw, np.array([1.0]))[0] - truth) < 0.3
    assert sm.Weights(np.array([0.0, 1.0]), np.zeros(2))(-3.0) == -3.0


def test_population():
    rng = np.random.default_rng(0)
    w = np.full(2000, 1 / 2000)
    x = rng.normal(0, 3, (2000, 2))
    level = np.array([normal(v) for v in x])
    step = sm.largest_step(w, level, 0.5, 1.0)
    assert 0 < step < 1 and math.isclose(sm.conditional_ess(w, step * level), 1000, rel_tol=1e-3) and sm.largest_step(w, level * 0, 0.5, 1.0) == 1.0
    y, rate = sm.population_walk(x, w, lambda v: -0.5 * (v**2).sum(1), 60, rng)
    assert abs(y.var(0).mean() - 1) < 0.15 and 0.05 < rate < 0.7
    assert sm.moves_needed(0.5) == 7 and sm.moves_needed(0) == 100 and sm.moves_needed(1) == 1


def test_readouts_and_fields():
    a, b = sm.WeightedSums(np.zeros(2)), sm.WeightedSums(np.zeros(2))
    a.add([1, 2], 2.0)
    b.add([4, 5])
    a.merge(b)
    assert np.allclose(a.mean, [2, 3])
    t, u = sm.Tally(), sm.Tally()
    t.add("x")
    u.add("x", 2)
    t.merge(u)
    d = sm.DrawStore(3)
    for k in range(10):
        d.add(k)
    assert t.counts == {"x": 3} and d.draws == [0, 3, 6, 9]
    f = sm.spectral_field(32, 2, 3.0, 1)
    assert math.isclose(f.std(), 1) and np.allclose(sm.sample_field(f, np.array([[3 / 32, 5 / 32], [0, 31 / 32]])), [f[3, 5], f[0, 31]])
    assert np.corrcoef(f[:, :-1].ravel(), f[:, 1:].ravel())[0, 1] > 0.8


@pytest.mark.parametrize("law", [laws.InverseGaussianKind(p=-0.5, a=2.0, b=1.0), laws.InverseGaussianKind(p=1.5, a=0.3, b=4.0), laws.ModifiedHalfNormal(a=2.5, b=1.0, c=1.0), laws.ModifiedHalfNormal(a=0.7, b=0.5, c=-1.0), laws.BetaPrime(p=2.0, a=1.5, b=3.0)])
def test_half_line_laws(law):
    g = np.exp(np.linspace(-18, 6, 20_001))
    p = law.density(g) * g
    h = np.diff(np.log(g))
    cdf = np.r_[0, np.cumsum((p[1:] + p[:-1]) / 2 * h)]
    assert math.isclose(cdf[-1], 1, abs_tol=2e-3)
    d = np.sort(law.draw(np.random.default_rng(1), 4000))
    assert np.abs(np.interp(np.log(d), np.log(g), cdf) - (np.arange(4000) + 0.5) / 4000).max() < 0.035
    if hasattr(law, "below") and not isinstance(law, laws.ModifiedHalfNormal):
        assert np.allclose(law.below(np.array([0.5, 2.0])), np.interp(np.log([0.5, 2.0]), np.log(g), cdf), atol=2e-3)


def test_special_functions():
    assert math.isclose(laws.log_bessel_k(0.5, 2.0), math.log(math.sqrt(math.pi / 4) * math.exp(-2)), rel_tol=1e-9)
    assert math.isclose(laws.log_bessel_k(1.5, 2.0), math.log(math.sqrt(math.pi / 4) * math.exp(-2) * 1.5), rel_tol=1e-9)
    assert math.isclose(laws.digamma(1.0), -0.5772156649015329, rel_tol=1e-9) and math.isclose(laws.digamma(0.5), -1.9635100260214235, rel_tol=1e-9)
    assert math.isclose(laws.log_rising(3.0, 2.0), math.log(12)) and math.isclose(laws.log_rising(2e6, 0.5), math.lgamma(2e6 + 0.5) - math.lgamma(2e6), abs_tol=1e-6)
    x, w = laws.gauss_legendre(6)
    assert math.isclose((w * x**10).sum(), 2 / 11) and math.isclose(laws.log_multigamma(3.0, 1), math.log(2))
    u = (x + 1) / 2
    p = laws.legendre(4, u)
    assert np.allclose((p.T * w / 2) @ p, np.eye(5))
    e = 1e-6
    assert np.allclose(laws.legendre_slope(4, u), (laws.legendre(4, u + e) - laws.legendre(4, u - e)) / (2 * e), atol=1e-5)
    assert math.isclose(laws.interval_poincare(lambda v: 0.0, 0.0, 2.0), (2 / math.pi) ** 2, rel_tol=1e-3)
    assert math.isclose(laws.tail_solve(lambda v: -v, -3.0, 0, 10, False), 3.0)


def test_mixtures_and_structures():
    gh = laws.generalised_hyperbolic(1.0, 2.0, 0.5, drift=0.3)
    x = np.linspace(-30, 40, 7001)
    assert math.isclose(gh.density(x).sum() * 0.01, 1, abs_tol=1e-3)
    d = gh.draw(np.random.default_rng(0), 4000)
    assert abs((d < 0.5).mean() - gh.below(0.5)[0]) < 0.03
    assert math.isclose(laws.normal_beta_prime(1.0, 1.0, 2.0).below(0.0)[0], 0.5, abs_tol=1e-3)
    e = laws.Empirical([3, 1, 2, 2])
    assert e.below(2) == 0.75 and e.interval(2, 3) == 0.75 and e.interval_moments(2, 2) == (0.5, 1.0, 2.0) and e.quantile(0.5) == 2
    mean = np.array([0.6, 0.8, 0.0])
    s = laws.PowerSpherical(mean, 5.0)
    v = s.draw(np.random.default_rng(0), 20_000)
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.allclose(v.mean(0) / np.linalg.norm(v.mean(0)), mean, atol=0.02)
    u = laws.PowerSpherical(mean, 0.0).draw(np.random.default_rng(1), 20_000)
    assert math.isclose(np.exp(s.log_density(u)).mean() * 4 * math.pi, 1, rel_tol=0.05)
    w = laws.InverseWishart(8.0, np.array([[2.0, 0.5], [0.5, 1.0]]))
    draws = np.array([w.draw(np.random.default_rng(k)) for k in range(8000)])
    assert np.allclose(draws.mean(0), w.scale / 5, atol=0.03)
    one = laws.InverseWishart(4.0, np.array([[3.0]]))
    assert math.isclose(one.log_density(np.array([[1.2]])), 2 * math.log(1.5) - math.lgamma(2) - 3 * math.log(1.2) - 1.5 / 1.2)
    weights = np.array([1.0, 2.0, 3.0, 0.5])
    total = 0.0
    for pair in itertools.combinations(range(4), 2):
        chance = sum(weights[a] / weights.sum() * weights[b] / (weights.sum() - weights[a]) for a, b in (pair, pair[::-1]))
        assert math.isclose(laws.wallenius(weights, list(pair)), chance, rel_tol=1e-6)
        total += chance
    assert math.isclose(total, 1)
    r = laws.ratio_of_uniforms(lambda x: -0.5 * x * x, 0.0, -math.sqrt(2 / math.e), math.sqrt(2 / math.e), np.random.default_rng(0), 5000)
    assert abs(r.var() - 1) < 0.08
