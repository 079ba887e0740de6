"""Monte Carlo inside a task: blocks, reversible jumps, tempering, flat histograms, reweighting, fields.

Every sampler takes a NumPy generator, so a chain is fixed by its seed; ``operators.sampling``
deals chains to tasks and gathers their draws as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np

Log = Callable[[np.ndarray], float]


def log_sum(x: np.ndarray) -> float:
    top = np.max(x)
    return float(top + math.log(np.exp(x - top).sum())) if np.isfinite(top) else float(top)


# Blocks: each takes a state to the next one

def random_walk(x: np.ndarray, at: float, log: Log, scale, rng: np.random.Generator) -> tuple[np.ndarray, float, bool]:
    """(state, its log density, whether it moved)."""
    y = x + scale * rng.standard_normal(np.shape(x))
    v = log(y)
    return (y, v, True) if math.log(rng.random() or 1e-300) < v - at else (x, at, False)


def slice_step(x: float, log: Callable[[float], float], width: float, rng: np.random.Generator, steps: int = 32) -> float:
    """One draw along the density's level, by stepping out and shrinking back."""
    level = log(x) + math.log(rng.random() or 1e-300)
    left = x - width * rng.random()
    right = left + width
    before = int(rng.integers(steps))
    behind = steps - 1 - before
    while before > 0 and log(left) > level:
        left, before = left - width, before - 1
    while behind > 0 and log(right) > level:
        right, behind = right + width, behind - 1
    while True:
        y = rng.uniform(left, right)
        if log(y) > level:
            return float(y)
        left, right = (y, right) if y < x else (left, y)
        if right - left < 1e-300:
            return float(x)


def newton_step(x: np.ndarray, log: Log, gradient: Callable, hessian: Callable, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """A normal proposal from the quadratic around the state, accepted with both ways' densities; flat directions get unit curvature."""
    def law(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, v = np.linalg.eigh(-hessian(z))
        w = np.where(w > 1e-8, w, 1.0)
        return z + v @ ((v.T @ gradient(z)) / w), (v * np.sqrt(w)) @ v.T  # mean, root of the precision

    def density(y: np.ndarray, mean: np.ndarray, root: np.ndarray) -> float:
        r = root @ (y - mean)
        return float(np.linalg.slogdet(root)[1] - 0.5 * r @ r)

    m, r = law(x)
    y = m + np.linalg.solve(r, rng.standard_normal(len(x)))
    back = law(y)
    ratio = log(y) - log(x) + density(x, *back) - density(y, m, r)
    return (y, True) if math.log(rng.random() or 1e-300) < ratio else (x, False)


def gaussian_conditional(precision_factor, mean: np.ndarray, rng: np.random.Generator, scale: float = 1.0) -> np.ndarray:
    """A draw from N(mean, scale^2 P^-1) by a factor with ``sample_inverse``."""
    return mean + scale * precision_factor.sample_inverse(rng)


def normal_variance(shape: float, scale: float, count: float, squares: float, rng: np.random.Generator) -> float:
    """The conjugate draw of a variance: inverse gamma with half the count and half the squares added."""
    return float((scale + squares / 2) / rng.gamma(shape + count / 2))


@dataclass
class Scan:
    """A fixed order of blocks, each (name, step(state, rng) -> (state, moved)), with how often each moved; its state can be kept and taken up again."""

    blocks: list
    state: object
    seed: int = 0
    counts: dict = field(default_factory=dict)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def step(self) -> None:
        for name, f in self.blocks:
            self.state, moved = f(self.state, self.rng)
            a, b = self.counts.get(name, (0, 0))
            self.counts[name] = (a + 1, b + bool(moved))

    def snapshot(self) -> dict:
        return {"state": deepcopy(self.state), "counts": dict(self.counts), "rng": deepcopy(self.rng.bit_generator.state)}

    def restore(self, s: dict) -> None:
        self.state, self.counts = deepcopy(s["state"]), dict(s["counts"])
        self.rng.bit_generator.state = deepcopy(s["rng"])


# Reversible jumps and tempering

@dataclass
class Chain:
    """Moves between states of any shape at an inverse temperature.

    A move is (name, weight(state), propose(state, rng) -> (state, log ratio) or None); the ratio holds
    proposals both ways and the prior, ``log_prior`` the prior that tempering leaves alone,
    ``log_likelihood`` what it bends.
    """

    moves: list
    log_likelihood: Callable
    log_prior: Callable
    state: object
    beta: float = 1.0
    seed: int = 0
    stats: dict = field(default_factory=dict)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.at = self.log_likelihood(self.state), self.log_prior(self.state)

    def step(self) -> bool:
        w = np.array([m[1](self.state) for m in self.moves], float)
        k = int(self.rng.choice(len(w), p=w / w.sum()))
        name, weight, propose = self.moves[k]
        a, b = self.stats.get(name, (0, 0))
        self.stats[name] = (a + 1, b)
        out = propose(self.state, self.rng)
        if out is None:
            return False
        new, ratio = out
        there = self.log_likelihood(new), self.log_prior(new)
        # the chance to pick this kind of move may differ on the other side: a proposal names its reverse's weights itself
        v = self.beta * (there[0] - self.at[0]) + there[1] - self.at[1] + ratio
        if math.log(self.rng.random() or 1e-300) < v:
            self.state, self.at = new, there
            self.stats[name] = (a + 1, b + 1)
            return True
        return False

    def snapshot(self) -> dict:
        return {"state": deepcopy(self.state), "at": self.at, "beta": self.beta, "stats": dict(self.stats), "rng": deepcopy(self.rng.bit_generator.state)}

    def restore(self, s: dict) -> None:
        self.state, self.at, self.beta, self.stats = deepcopy(s["state"]), s["at"], s["beta"], dict(s["stats"])
        self.rng.bit_generator.state = deepcopy(s["rng"])


@dataclass
class Ladder:
    """Chains at rising inverse temperatures that swap states with neighbours, even and odd pairs by turns."""

    chains: list[Chain]
    seed: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.tries, self.swaps, self.turn = np.zeros(len(self.chains) - 1), np.zeros(len(self.chains) - 1), 0
        self.levels: list[list[float]] = [[] for _ in self.chains]

    def step(self, moves: int = 1, record: bool = True) -> None:
        for c in self.chains:
            for _ in range(moves):
                c.step()
        for k in range(self.turn, len(self.chains) - 1, 2):
            a, b = self.chains[k], self.chains[k + 1]
            self.tries[k] += 1
            if math.log(self.rng.random() or 1e-300) < (a.beta - b.beta) * (b.at[0] - a.at[0]):
                a.state, b.state, a.at, b.at = b.state, a.state, b.at, a.at
                self.swaps[k] += 1
        self.turn ^= 1
        if record:
            for c, l in zip(self.chains, self.levels, strict=True):
                l.append(c.at[0])

    @property
    def betas(self) -> np.ndarray:
        return np.array([c.beta for c in self.chains])

    @property
    def rejection(self) -> np.ndarray:
        return 1 - self.swaps / np.maximum(self.tries, 1)


def barrier(rejection: np.ndarray) -> float:
    """The communication barrier: rejections added up along the ladder."""
    return float(np.sum(rejection))


def round_trip_rate(rejection: np.ndarray) -> float:
    """Round trips a step of a deterministic even-odd schedule: 1 / (2 + 2 sum r / (1 - r))."""
    r = np.asarray(rejection, float)
    return float(1 / (2 + 2 * (r / np.maximum(1 - r, 1e-12)).sum()))


def equalised(betas: np.ndarray, rejection: np.ndarray, levels: int | None = None) -> np.ndarray:
    """Inverse temperatures between the same ends at equal shares of the barrier, by a line through its running sum."""
    total = np.r_[0, np.cumsum(np.maximum(rejection, 1e-9))]
    return np.interp(np.linspace(0, total[-1], levels or len(betas)), total, betas)


def recommended_levels(rejection: np.ndarray) -> int:
    """About one rung for each half of the barrier, which makes round trips most frequent, and the two ends."""
    return max(2, math.ceil(2 * barrier(rejection)) + 1)


# Evidence

def stepping_stone(betas: np.ndarray, levels: list[np.ndarray]) -> tuple[float, float]:
    """(log evidence ratio from the first rung to the last, standard error) from log likelihoods at each rung."""
    total = variance = 0.0
    for k in range(len(betas) - 1):
        x = (betas[k + 1] - betas[k]) * np.asarray(levels[k], float)
        w = np.exp(x - x.max())
        total += float(x.max() + math.log(w.mean()))
        variance += float(w.var() / len(w) / w.mean() ** 2)
    return total, math.sqrt(variance)


def path_sampling(betas: np.ndarray, levels: list[np.ndarray]) -> float:
    """The same by trapezia of mean log likelihoods, corrected by their variances at the ends of each."""
    m, v = np.array([np.mean(x) for x in levels]), np.array([np.var(x) for x in levels])
    h = np.diff(betas)
    return float((h * (m[1:] + m[:-1]) / 2 - h**2 * (v[1:] - v[:-1]) / 12).sum())


# Flat histograms

@dataclass
class Weights:
    """Piecewise-linear log weights over the level, flat at their last node beyond it and falling with ``slope`` below the first.

    A slope of 0 leaves the prior alone below the nodes, which reweighting to it needs; 1 is the posterior's.
    """

    nodes: np.ndarray
    values: np.ndarray
    slope: float = 1.0

    def __call__(self, level: float) -> float:
        if level < self.nodes[0]:
            return float(self.values[0] - self.slope * (self.nodes[0] - level))
        return float(np.interp(level, self.nodes, self.values))

    def bin(self, level: float) -> int | None:
        k = int(np.searchsorted(self.nodes, level, "right")) - 1
        return k if 0 <= k < len(self.nodes) - 1 else None


@dataclass
class Multicanonical:
    """A chain whose target is the prior times learned weights of the log likelihood, so that all levels are visited alike.

    Learning is stochastic approximation: a visit lowers its bin's log weight, all less and less.
    """

    chain: Chain
    weights: Weights
    gain: float = 1.0
    burn: float = 200.0

    def __post_init__(self):
        self.likelihood = self.chain.log_likelihood
        self.n, self.visits = 0, np.zeros(len(self.weights.nodes) - 1)
        self._retarget()

    def _retarget(self) -> None:
        self.level = self.likelihood(self.chain.state)
        self.chain.log_likelihood = lambda s: self.weights(self.likelihood(s))
        self.chain.beta = 1.0
        self.chain.at = self.weights(self.level), self.chain.log_prior(self.chain.state)

    def step(self, learn: bool = False) -> float:
        self.chain.step()
        self.level = self.likelihood(self.chain.state)
        k = self.weights.bin(self.level)
        self.n += 1
        if k is not None:
            self.visits[k] += 1
        if learn and k is not None:
            a = self.gain * self.burn / max(self.burn, self.n)
            self.weights.values[k : k + 2] -= a / 2
            self.weights.values += a / len(self.weights.values)
            self.chain.at = self.weights(self.level), self.chain.at[1]
        return self.level

    def flatness(self) -> float:
        """The least visited bin's share of the mean."""
        return float(self.visits.min() / max(self.visits.mean(), 1e-300))


def round_trips(levels: np.ndarray, low: float, high: float) -> int:
    """How often a walk of levels went from at most ``low`` to at least ``high`` and back."""
    trips, side = 0, None
    for x in levels:
        if x <= low:
            trips += side == "up"
            side = "down"
        elif x >= high and side == "down":
            side = "up"
    return trips


def reweight(levels: np.ndarray, log_weights: np.ndarray, beta: float, values: np.ndarray | None = None) -> tuple[np.ndarray, float, float | None]:
    """(normalised weights, effective draws, mean of ``values``) at an inverse temperature, from draws under log weights of their level."""
    x = beta * np.asarray(levels, float) - np.asarray(log_weights, float)
    w = np.exp(x - x.max())
    w /= w.sum()
    return w, float(1 / (w**2).sum()), None if values is None else float(w @ np.asarray(values, float))


def log_evidence_curve(levels: np.ndarray, log_weights: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """log Z(beta) - log Z(0) from the same draws."""
    l, w = np.asarray(levels, float), np.asarray(log_weights, float)
    return np.array([log_sum(b * l - w) - log_sum(-w) for b in betas])


def wham(betas: np.ndarray, levels: list[np.ndarray], nodes: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(log density of states by bin, log normalisers by rung) that agree with the histograms of all rungs at once; empty bins are -inf."""
    h = np.array([np.histogram(x, nodes)[0] for x in levels], float)
    mid = (nodes[1:] + nodes[:-1]) / 2
    n, total = h.sum(1), h.sum(0)
    held = total > 0
    log_z = np.zeros(len(betas))
    with np.errstate(divide="ignore"):
        for _ in range(rounds):
            bottom = np.logaddexp.reduce(np.log(np.maximum(n, 1e-300))[:, None] + betas[:, None] * mid - log_z[:, None], axis=0)
            log_g = np.where(held, np.log(np.maximum(total, 1e-300)) - bottom, -np.inf)
            new = np.array([log_sum((b * mid + log_g)[held]) for b in betas])
            new -= new[0]
            done = np.abs(new - log_z).max() < tolerance
            log_z = new
            if done:
                break
    return log_g - log_sum(log_g[held]), log_z


# Populations

def conditional_ess(weights: np.ndarray, log_increments: np.ndarray) -> float:
    """Draws that an increment of log weights leaves, of all."""
    w = np.exp(log_increments - log_increments.max())
    return float(len(w) * (weights @ w) ** 2 / (weights @ w**2))


def largest_step(weights: np.ndarray, levels: np.ndarray, share: float, most: float) -> float:
    """The greatest step in inverse temperature that keeps ``share`` of the draws, by bisection."""
    if conditional_ess(weights, most * levels) >= share * len(levels):
        return most
    lo, hi = 0.0, most
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if conditional_ess(weights, mid * levels) >= share * len(levels) else (lo, mid)
    return lo


def moves_needed(acceptance: float, chance: float = 0.01, most: int = 100) -> int:
    """Moves after which a particle has stood still with at most ``chance``."""
    return most if acceptance <= 0 else 1 if acceptance >= 1 else min(most, max(1, math.ceil(math.log(chance) / math.log(1 - acceptance))))


def population_walk(particles: np.ndarray, weights: np.ndarray, log: Callable[[np.ndarray], np.ndarray], steps: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(particles, acceptance): random walks scaled by the population's covariance, 2.38 over the root of the dimension."""
    d = particles.shape[1]
    m = weights @ particles
    c = (particles - m).T @ ((particles - m) * weights[:, None])
    root = np.linalg.cholesky(c + 1e-12 * np.eye(d)) * 2.38 / math.sqrt(d)
    x, at, moved = particles.copy(), log(particles), 0.0
    for _ in range(steps):
        y = x + rng.standard_normal(x.shape) @ root.T
        v = log(y)
        ok = np.log(np.maximum(rng.random(len(x)), 1e-300)) < v - at
        x[ok], at[ok] = y[ok], v[ok]
        moved += ok.mean() / steps
    return x, float(moved)


# Mergeable readouts

@dataclass
class WeightedSums:
    """Weighted sums of vectors; two of them merge to that of both."""

    sums: np.ndarray
    weight: float = 0.0

    def add(self, x: np.ndarray, weight: float = 1.0) -> None:
        self.sums = self.sums + weight * np.asarray(x, float)
        self.weight += weight

    def merge(self, other: WeightedSums) -> None:
        self.sums, self.weight = self.sums + other.sums, self.weight + other.weight

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.weight


@dataclass
class Tally:
    """Counts by key."""

    counts: dict = field(default_factory=dict)

    def add(self, key, n: int = 1) -> None:
        self.counts[key] = self.counts.get(key, 0) + n

    def merge(self, other: Tally) -> None:
        for k, n in other.counts.items():
            self.add(k, n)


@dataclass
class DrawStore:
    """Every ``thin``-th draw."""

    thin: int = 1
    seen: int = 0
    draws: list = field(default_factory=list)

    def add(self, x) -> None:
        if self.seen % self.thin == 0:
            self.draws.append(deepcopy(x))
        self.seen += 1


# Fields

def spectral_field(size: int, dims: int, beta: float, seed: int = 0) -> np.ndarray:
    """A standardised Gaussian field on a periodic grid whose power falls with frequency to the ``beta``."""
    from .linalg import fft_nd

    rng = np.random.default_rng(seed)
    axes = np.meshgrid(*[np.minimum(np.arange(size), size - np.arange(size))] * dims, indexing="ij")
    f = np.sqrt(sum(a.astype(float) ** 2 for a in axes))
    amplitude = np.where(f > 0, np.maximum(f, 1e-300) ** (-beta / 2), 0.0)
    x = np.real(fft_nd(fft_nd(rng.standard_normal((size,) * dims)) * amplitude, inverse=True))
    return (x - x.mean()) / x.std()


def sample_field(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Multilinear interpolation at points of the unit cube, periodic."""
    size, d = values.shape[0], values.ndim
    u = np.asarray(points, float) % 1.0 * size
    lo = np.floor(u).astype(int)
    t = u - lo
    out = np.zeros(len(u))
    for corner in range(1 << d):
        bits = np.array([(corner >> k) & 1 for k in range(d)])
        out += np.prod(np.where(bits, t, 1 - t), 1) * values[tuple(((lo + bits) % size).T)]
    return out
