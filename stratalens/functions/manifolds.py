"""Manifolds with distances, logarithms and exponentials, and iteratively reweighted locations on them (NumPy).

A point is an array; tangent vectors have its shape. Spheres, balls and flat space are in
``operators.geometry`` too, whose passes over tables take any of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .linalg import orthonormal


class Space:
    """log(p, q): the tangent vector at p that leads to q; exp(p, v): where it leads."""

    def log(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def exp(self, p: np.ndarray, v: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def norm(self, p: np.ndarray, v: np.ndarray) -> float:
        return float(np.linalg.norm(v))

    def distance(self, p: np.ndarray, q: np.ndarray) -> float:
        return self.norm(p, self.log(p, q))


class Euclidean(Space):
    def log(self, p, q):
        return q - p

    def exp(self, p, v):
        return p + v


class Sphere(Space):
    def log(self, p, q):
        v = q - (p @ q) * p
        n = np.linalg.norm(v)
        return np.zeros_like(p) if n < 1e-15 else math.atan2(n, p @ q) * v / n

    def exp(self, p, v):
        n = np.linalg.norm(v)
        x = p if n < 1e-15 else math.cos(n) * p + math.sin(n) * v / n
        return x / np.linalg.norm(x)


class Hyperboloid(Space):
    """Points with -x0^2 + |x|^2 = -1, x0 > 0."""

    @staticmethod
    def inner(u, v):
        return float(u[1:] @ v[1:] - u[0] * v[0])

    def log(self, p, q):
        c = max(-self.inner(p, q), 1.0)
        v = q - c * p
        n = math.sqrt(max(self.inner(v, v), 0.0))
        return np.zeros_like(p) if n < 1e-15 else math.acosh(c) * v / n

    def exp(self, p, v):
        n = self.norm(p, v)
        x = p if n < 1e-15 else math.cosh(n) * p + math.sinh(n) * v / n
        x = x.copy()
        x[0] = math.sqrt(1 + x[1:] @ x[1:])
        return x

    def norm(self, p, v):
        return math.sqrt(max(self.inner(v, v), 0.0))


class Ball(Space):
    """The unit ball with curvature -1; vectors are measured by the conformal factor at their point."""

    @staticmethod
    def add(p, q):
        d, pp, qq = p @ q, p @ p, q @ q
        return ((1 + 2 * d + qq) * p + (1 - pp) * q) / (1 + 2 * d + pp * qq)

    def log(self, p, q):
        u = self.add(-p, q)
        n = np.linalg.norm(u)
        return np.zeros_like(p) if n < 1e-15 else (1 - p @ p) * math.atanh(min(n, 1 - 1e-15)) * u / n

    def exp(self, p, v):
        n = np.linalg.norm(v)
        return p if n < 1e-15 else self.add(p, math.tanh(n / (1 - p @ p)) * v / n)

    def norm(self, p, v):
        return 2 * float(np.linalg.norm(v)) / (1 - float(p @ p))


class Grassmann(Space):
    """Subspaces by orthonormal columns."""

    def log(self, p, q):
        m = p.T @ q
        l = q @ np.linalg.inv(m) - p
        u, s, vt = np.linalg.svd(l, full_matrices=False)
        return u * np.arctan(s) @ vt

    def exp(self, p, v):
        u, s, vt = np.linalg.svd(v, full_matrices=False)
        return orthonormal(p @ vt.T * np.cos(s) @ vt + u * np.sin(s) @ vt)

    def distance(self, p, q):
        """From the principal angles, which stay defined where the logarithm does not."""
        from .linalg import principal_angles

        return float(np.linalg.norm(principal_angles(p, q)))


class Stiefel(Space):
    """Orthonormal frames with the canonical metric; the logarithm is found by shooting."""

    def exp(self, p, v):
        n = p.shape[1]
        a = p.T @ v
        q, r = np.linalg.qr(v - p @ a)
        m = np.block([[a, -r.T], [r, np.zeros((n, n))]])
        w, u = np.linalg.eigh(1j * m)  # skew: its exponential is a rotation
        turn = np.real((u * np.exp(-1j * w)) @ u.conj().T)
        return p @ turn[:n, :n] + q @ turn[n:, :n]

    def log(self, p, q, rounds: int = 200, tolerance: float = 1e-12):
        v = self.project(p, q - p)
        for _ in range(rounds):
            gap = q - self.exp(p, v)
            if np.linalg.norm(gap) < tolerance:
                break
            v = self.project(p, v + self.project(p, gap))
        return v

    @staticmethod
    def project(p, v):
        s = p.T @ v
        return v - p @ (s + s.T) / 2

    def norm(self, p, v):
        a = p.T @ v
        return math.sqrt(max(float((v * v).sum() - 0.5 * (a * a).sum()), 0.0))


@dataclass
class Product(Space):
    """Two spaces side by side; a point is a tuple."""

    one: Space
    two: Space

    def log(self, p, q):
        return self.one.log(p[0], q[0]), self.two.log(p[1], q[1])

    def exp(self, p, v):
        return self.one.exp(p[0], v[0]), self.two.exp(p[1], v[1])

    def norm(self, p, v):
        return math.hypot(self.one.norm(p[0], v[0]), self.two.norm(p[1], v[1]))


@dataclass
class Scaled(Space):
    """The same space with lengths multiplied."""

    base: Space
    scale: float

    def log(self, p, q):
        return self.base.log(p, q)

    def exp(self, p, v):
        return self.base.exp(p, v)

    def norm(self, p, v):
        return self.scale * self.base.norm(p, v)


LOSSES: dict[str, Callable[[float], float]] = {"l2": lambda r: 1.0, "l1": lambda r: 1 / max(r, 1e-12), "huber": lambda r: 1.0 if r <= 1.345 else 1.345 / r, "cauchy": lambda r: 1 / (1 + (r / 2.385) ** 2)}


def irls(space: Space, points: list, loss: str = "l1", weights: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-10, scaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(location, final weights): steps along the weighted mean of logarithms; ``scaled`` divides distances by their median first.

    A point that the location falls on keeps a bounded weight, so the l1 step stays defined.
    """
    w0 = np.ones(len(points)) if weights is None else np.asarray(weights, float)
    at = points[int(np.argmax(w0))]
    w = w0
    for i in range(rounds):
        logs = [space.log(at, q) for q in points]
        r = np.array([space.norm(at, v) for v in logs])
        s = float(np.median(r)) or 1.0 if scaled else 1.0
        w = w0 * np.array([LOSSES[loss if i >= 5 else "l2"](x / s) for x in r])  # the mean is the start: a point would hold an l1 step fast
        step = sum(a * v for a, v in zip(w / w.sum(), logs, strict=True))
        at = space.exp(at, step)
        if i >= 6 and space.norm(at, step) < tolerance:
            break
    return at, w / w.sum()


def scatter(space: Space, points: list, at: np.ndarray, weights: np.ndarray | None = None, shape: bool = False) -> np.ndarray:
    """Second moments of logarithms at a location; with ``shape`` each is divided by its squared length, as beside a median."""
    w = np.full(len(points), 1 / len(points)) if weights is None else np.asarray(weights) / np.sum(weights)
    out = 0.0
    for a, q in zip(w, points, strict=True):
        v = np.ravel(space.log(at, q))
        n = v @ v
        out = out + a * np.outer(v, v) / (n if shape and n > 1e-300 else 1.0)
    return out


def consistency(dim: int, law: str = "gaussian") -> float:
    """What a mean distance from the centre is multiplied by to give the scale: of a standard normal, or of a Laplace law in that dimension."""
    mean = math.sqrt(2) * math.exp(math.lgamma((dim + 1) / 2) - math.lgamma(dim / 2)) if law == "gaussian" else float(dim)
    return 1 / mean


def heat_bandwidth(beta: float) -> float:
    """The length that a heat kernel at inverse time beta reaches."""
    return math.sqrt(1 / (2 * beta))


def sphere_second_moment(beta: float, dim: int, steps: int = 4000) -> float:
    """Mean squared angle under exp(-beta angle^2) on a sphere of that dimension."""
    t = (np.arange(steps) + 0.5) * math.pi / steps
    w = np.exp(-beta * t * t) * np.sin(t) ** (dim - 1)
    return float((w * t * t).sum() / w.sum())


def hyperbolic_second_moment(beta: float, dim: int, steps: int = 20_000) -> float:
    """The same on hyperbolic space, by distance."""
    reach = (dim - 1 + math.sqrt((dim - 1) ** 2 + 8 * beta * 40)) / (4 * beta) + 1
    t = (np.arange(steps) + 0.5) * reach / steps
    lw = -beta * t * t + (dim - 1) * (t + np.log1p(-np.exp(-2 * t)))
    w = np.exp(lw - lw.max())
    return float((w * t * t).sum() / w.sum())


def match_beta(moment: Callable[[float, int], float], observed: float, dim: int) -> float:
    """The inverse time whose second moment is the observed one, by bisection in the logarithm; moments fall with beta."""
    lo, hi = math.log(1e-6), math.log(1e6)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(math.exp(mid), dim) > observed else (lo, mid)
    return math.exp((lo + hi) / 2)


def anneal_subspace(data: np.ndarray, k: int, objective: Callable[[np.ndarray], float], rounds: int = 1000, start: float = 1.0, end: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """(columns, value): an orthonormal basis whose projection makes ``objective`` small, by random turns that cool."""
    rng = np.random.default_rng(seed)
    x = data - data.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    p = vt[:k].T
    at = objective(x @ p)
    best = p, at
    g = Grassmann()
    for i in range(rounds):
        t = start * (end / start) ** (i / max(rounds - 1, 1))
        v = rng.standard_normal(p.shape) * t
        q = g.exp(p, v - p @ (p.T @ v))
        new = objective(x @ q)
        if new < at or rng.random() < math.exp(-(new - at) / max(t * abs(best[1]), 1e-300)):
            p, at = q, new
            if at < best[1]:
                best = p, at
    return best


def largest_mean_factor(x: np.ndarray, y: np.ndarray, alpha: float = 2.0, gamma: float | None = None) -> float:
    """The greatest log Bayes factor over coordinates for two samples' means to differ."""
    n, m = len(x), len(y)
    g = gamma if gamma is not None else max(n + m, x.shape[1]) ** -alpha
    both = np.r_[x, y]
    s0 = ((both - both.mean(0)) ** 2).sum(0)
    s1 = ((x - x.mean(0)) ** 2).sum(0) + ((y - y.mean(0)) ** 2).sum(0)
    shrunk = (s1 + g * s0) / (1 + g)
    return float((0.5 * math.log(g / (1 + g)) + (n + m) / 2 * (np.log(np.maximum(s0, 1e-300)) - np.log(np.maximum(shrunk, 1e-300)))).max())
