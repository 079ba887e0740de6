"""Further laws: inverse Gaussian kinds and their mixtures, directions, matrices, subsets, quadrature."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .distributions import Law, beta_lower


# Quadrature and special functions

def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1]: the spectrum of the recurrence's symmetric matrix."""
    k = np.arange(1, n)
    b = k / np.sqrt(4.0 * k * k - 1)
    w, v = np.linalg.eigh(np.diag(b, 1) + np.diag(b, -1))
    return w, 2 * v[0] ** 2


def legendre(degree: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal shifted polynomials 0 .. degree on [0, 1], by columns."""
    t = 2 * np.asarray(x, float) - 1
    out = [np.ones_like(t), t]
    for k in range(1, degree):
        out.append(((2 * k + 1) * t * out[-1] - k * out[-2]) / (k + 1))
    return np.stack([p * math.sqrt(2 * k + 1) for k, p in enumerate(out[: degree + 1])], -1)


def legendre_slope(degree: int, x: np.ndarray) -> np.ndarray:
    """Their derivatives, from the polynomials below of opposite parity."""
    p = legendre(max(degree, 1), x)
    out = np.zeros((*np.shape(x), degree + 1))
    for k in range(1, degree + 1):
        for j in range(k - 1, -1, -2):
            out[..., k] += 2 * math.sqrt(2 * k + 1) * math.sqrt(2 * j + 1) * p[..., j]
    return out


def digamma(x: float) -> float:
    """By its recurrence up to 10 and the asymptotic series from there."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_rising(x: float, s: float) -> float:
    """log Gamma(x + s) / Gamma(x), without the difference of two large numbers where x is large."""
    if x < 1e6:
        return math.lgamma(x + s) - math.lgamma(x)
    return s * math.log(x) + s * (s - 1) / (2 * x)


def log_multigamma(x: float, p: int) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - j / 2) for j in range(p))


def log_bessel_k(nu: float, x: float) -> float:
    """log K_nu(x): the integral of exp(-x cosh t) cosh(nu t) over t, around its peak in logarithms."""
    nu = abs(nu)
    peak = math.asinh(nu / x)  # of nu t - x cosh t
    top = nu * peak - x * math.cosh(peak)
    # the integrand is below e^-50 of its peak beyond this
    hi = peak + 1.0
    while nu * hi - x * math.cosh(hi) > top - 50:
        hi += 0.5
    t, w = gauss_legendre(200)
    total = 0.0
    for a, b in ((0.0, peak), (peak, hi)):
        if b > a:
            z = (b - a) / 2 * t + (a + b) / 2
            total += float(((b - a) / 2 * w * np.exp(nu * z - x * np.cosh(z) - top) * (1 + np.exp(-2 * nu * z)) / 2).sum())
    return top + math.log(total)


# Laws on the half line

@dataclass(frozen=True)
class InverseGaussianKind(Law):
    """Density in proportion to x^(p - 1) exp(-(a x + b / x) / 2)."""

    low: float = 0.0
    p: float = 1.0
    a: float = 1.0
    b: float = 1.0

    @property
    def log_normaliser(self) -> float:
        w = math.sqrt(self.a * self.b)
        return math.log(2) + log_bessel_k(self.p, w) + self.p / 2 * math.log(self.b / self.a)

    def log_density(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, (self.p - 1) * np.log(x) - (self.a * x + self.b / x) / 2 - self.log_normaliser, -np.inf)

    def density(self, x):
        return np.exp(self.log_density(x))

    def below(self, x):
        return np.array([_mass(self.log_density, v, self._mode()) for v in np.atleast_1d(np.asarray(x, float))])

    def _mode(self) -> float:
        return (self.p - 1 + math.sqrt((self.p - 1) ** 2 + self.a * self.b)) / self.a

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Ratio of uniforms around the mode of the logarithm, whose density is log-concave."""
        f = lambda u: self.p * u - (self.a * np.exp(u) + self.b * np.exp(-u)) / 2
        return np.exp(log_concave_draws(f, math.log((self.p + math.sqrt(self.p**2 + self.a * self.b)) / self.a), rng, n))


def _mass(log_density, x: float, mode: float) -> float:
    """Of (0, x], in the logarithm of the variable, by panels around the mode."""
    if x <= 0:
        return 0.0
    t, w = gauss_legendre(40)
    hi, total = math.log(x), 0.0
    lo = min(hi, math.log(mode)) - 1
    while log_density(math.exp(lo)) + lo > log_density(mode) + math.log(mode) - 45:
        lo -= 1
    for a in np.arange(lo, hi, 0.5):
        b = min(a + 0.5, hi)
        z = (b - a) / 2 * t + (a + b) / 2
        total += float(((b - a) / 2 * w * np.exp(log_density(np.exp(z)) + z)).sum())
    return min(total, 1.0)


def log_concave_draws(f, mode: float, rng: np.random.Generator, n: int) -> np.ndarray:
    """Exact draws from exp(f) with f concave: flat around the mode, exponential tails from where f has fallen by one."""
    top = float(f(mode))

    def reach(sign: float) -> float:
        step = 1.0
        while f(mode + sign * step) > top - 1:
            step *= 2
        lo, hi = 0.0, step
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mode + sign * mid) > top - 1 else (lo, mid)
        return hi

    left, right = reach(-1), reach(1)
    # beyond a reach r the concave f falls at least as fast as the chord: 1 / r
    mass = np.array([left * math.exp(-1), left + right, right * math.exp(-1)])
    out = np.zeros(0)
    while len(out) < n:
        k = rng.choice(3, 2 * (n - len(out)) + 16, p=mass / mass.sum())
        e = rng.exponential(size=len(k))
        x = np.where(k == 0, mode - left * (1 + e), np.where(k == 2, mode + right * (1 + e), rng.uniform(mode - left, mode + right, len(k))))
        hat = np.where(k == 1, 0.0, -1 - e)
        out = np.r_[out, x[np.log(np.maximum(rng.random(len(k)), 1e-300)) < f(x) - top - hat]]
    return out[:n]


def ratio_of_uniforms(log_density, mode: float, left: float, right: float, rng: np.random.Generator, n: int) -> np.ndarray:
    """Draws by points under the root of the density; ``left`` and ``right`` bound (x - mode) times that root."""
    top = float(log_density(mode))
    out = np.zeros(0)
    while len(out) < n:
        u = rng.random(4 * n + 16)
        x = mode + rng.uniform(left, right, len(u)) / np.maximum(u, 1e-300)
        with np.errstate(all="ignore"):
            out = np.r_[out, x[2 * np.log(np.maximum(u, 1e-300)) <= log_density(x) - top]]
    return out[:n]


@dataclass(frozen=True)
class BetaPrime(Law):
    """Generalised: (X / (1 - X))^(1 / p) of a Beta(a, b) variable X."""

    low: float = 0.0
    p: float = 1.0
    a: float = 1.0
    b: float = 1.0

    def log_density(self, x):
        x = np.asarray(x, float)
        norm = math.lgamma(self.a) + math.lgamma(self.b) - math.lgamma(self.a + self.b)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, math.log(self.p) + (self.p * self.a - 1) * np.log(x) - (self.a + self.b) * np.log1p(x**self.p) - norm, -np.inf)

    def density(self, x):
        return np.exp(self.log_density(x))

    def below(self, x):
        return np.array([beta_lower(self.a, self.b, v**self.p / (1 + v**self.p)) if v > 0 else 0.0 for v in np.atleast_1d(np.asarray(x, float))])

    def log_moment(self, k: float) -> float:
        """Of x^k; infinite where b does not allow it."""
        if not -self.a < k / self.p < self.b:
            return math.inf
        return math.lgamma(self.a + k / self.p) + math.lgamma(self.b - k / self.p) - math.lgamma(self.a) - math.lgamma(self.b)


@dataclass(frozen=True)
class ModifiedHalfNormal(Law):
    """Density in proportion to x^(a - 1) exp(-b x^2 + c x) on the half line."""

    low: float = 0.0
    a: float = 1.0
    b: float = 1.0
    c: float = 0.0

    def _kernel(self, x):
        return (self.a - 1) * np.log(x) - self.b * x * x + self.c * x

    def _mode(self) -> float:
        return (self.c + math.sqrt(self.c**2 + 8 * self.b * max(self.a, 1e-9))) / (4 * self.b)

    @property
    def log_normaliser(self) -> float:
        m = self._mode()
        top = float(self._kernel(m) + math.log(m))
        t, w = gauss_legendre(60)
        lo, hi = math.log(m), math.log(m)
        f = lambda u: self._kernel(np.exp(u)) + u
        while f(lo) > top - 45:
            lo -= 1
        while f(hi) > top - 45:
            hi += 0.25
        edges = np.linspace(lo, hi, 60)
        return top + math.log(sum(float(((b - a) / 2 * w * np.exp(f((b - a) / 2 * t + (a + b) / 2) - top)).sum()) for a, b in zip(edges, edges[1:])))

    def log_density(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, self._kernel(x) - self.log_normaliser, -np.inf)

    def density(self, x):
        return np.exp(self.log_density(x))

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """In the logarithm; its density a u - b e^2u + c e^u is log-concave where c <= 0 and unimodal else: rejection under either hat."""
        f = lambda u: self.a * u - self.b * np.exp(2 * u) + self.c * np.exp(u)
        if self.c <= 0:
            return np.exp(log_concave_draws(f, math.log(self._mode()), rng, n))
        # x itself is log-concave for a >= 1; below, the power's share is taken out by rejection under x <= 1 or a normal tail
        if self.a >= 1:
            g = lambda x: np.where(x > 0, (self.a - 1) * np.log(np.maximum(x, 1e-300)) - self.b * x * x + self.c * x, -np.inf)
            m = (self.c + math.sqrt(self.c**2 + 8 * self.b * (self.a - 1))) / (4 * self.b)
            return log_concave_draws(g, m, rng, n)
        grid = np.exp(np.linspace(math.log(1e-12), math.log(self._mode() + 12 / math.sqrt(self.b)), 20_001))
        k = np.maximum(grid, 1e-300)
        w = np.exp(self._kernel(k) - self._kernel(k).max()) * k
        cdf = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(np.log(grid)))]
        return np.exp(np.interp(rng.random(n) * cdf[-1], cdf, np.log(grid)))


# Mixtures of normals over a law of the variance

@dataclass(frozen=True)
class NormalMixture(Law):
    """location + drift V + scale sqrt(V) Z with V from ``mixing``, a law with ``log_density`` on the half line."""

    mixing: object = None
    location: float = 0.0
    drift: float = 0.0
    scale: float = 1.0

    def _nodes(self) -> tuple[np.ndarray, np.ndarray]:
        f = lambda u: self.mixing.log_density(np.exp(u)) + u
        grid = np.linspace(-40, 40, 2001)
        v = f(grid)
        live = grid[v > v.max() - 50]
        t, w = gauss_legendre(24)
        nodes, weights = [], []
        edges = np.linspace(live[0], live[-1], 41)
        for a, b in zip(edges, edges[1:]):
            z = (b - a) / 2 * t + (a + b) / 2
            nodes.append(np.exp(z))
            weights.append((b - a) / 2 * w * np.exp(f(z)))
        return np.concatenate(nodes), np.concatenate(weights)

    def density(self, x):
        v, w = self._nodes()
        x = np.atleast_1d(np.asarray(x, float))
        sd = self.scale * np.sqrt(v)
        z = (x[:, None] - self.location - self.drift * v) / sd
        return (np.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi)) * w).sum(1)

    def below(self, x):
        v, w = self._nodes()
        x = np.atleast_1d(np.asarray(x, float))
        z = (x[:, None] - self.location - self.drift * v) / (self.scale * np.sqrt(v))
        return (0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) * w).sum(1)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        v = self.mixing.draw(rng, n)
        return self.location + self.drift * v + self.scale * np.sqrt(v) * rng.standard_normal(n)


def generalised_hyperbolic(p: float, a: float, b: float, drift: float = 0.0, scale: float = 1.0) -> NormalMixture:
    return NormalMixture(mixing=InverseGaussianKind(p=p, a=a, b=b), drift=drift, scale=scale)


def normal_beta_prime(p: float, a: float, b: float, drift: float = 0.0, scale: float = 1.0) -> NormalMixture:
    return NormalMixture(mixing=BetaPrime(p=p, a=a, b=b), drift=drift, scale=scale)


# Samples, directions, matrices, subsets

class Empirical:
    """Atoms at a sample's values."""

    def __init__(self, sample):
        self.x = np.sort(np.asarray(sample, float))

    def below(self, v: float) -> float:
        return float(np.searchsorted(self.x, v, "right") / len(self.x))

    def interval(self, low: float, high: float) -> float:
        """Mass of [low, high]."""
        return float((np.searchsorted(self.x, high, "right") - np.searchsorted(self.x, low, "left")) / len(self.x))

    def interval_moments(self, low: float, high: float) -> tuple[float, float, float]:
        """(mass, first, second moment) on [low, high]."""
        part = self.x[np.searchsorted(self.x, low, "left") : np.searchsorted(self.x, high, "right")]
        return len(part) / len(self.x), float(part.sum() / len(self.x)), float((part**2).sum() / len(self.x))

    def quantile(self, p: float) -> float:
        return float(self.x[min(max(math.ceil(p * len(self.x)) - 1, 0), len(self.x) - 1)])


@dataclass(frozen=True)
class PowerSpherical:
    """Directions around ``mean``: density in proportion to (1 + mean . x)^k."""

    mean: np.ndarray
    k: float

    def _shapes(self) -> tuple[float, float]:
        d = len(self.mean)
        return (d - 1) / 2 + self.k, (d - 1) / 2

    def log_density(self, x: np.ndarray) -> np.ndarray:
        a, b = self._shapes()
        norm = (a + b) * math.log(2) + b * math.log(math.pi) + math.lgamma(a) - math.lgamma(a + b)
        return self.k * np.log1p(np.asarray(x) @ self.mean) - norm

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        d = len(self.mean)
        t = 2 * rng.beta(*self._shapes(), n) - 1
        v = rng.standard_normal((n, d - 1))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        y = np.c_[t, np.sqrt(np.maximum(1 - t * t, 0))[:, None] * v]
        u = np.eye(d)[0] - self.mean
        size = np.linalg.norm(u)
        return y if size < 1e-12 else y - 2 * np.outer(y @ (u / size), u / size)


@dataclass(frozen=True)
class InverseWishart:
    """Of a covariance: ``df`` degrees of freedom and a scale matrix."""

    df: float
    scale: np.ndarray

    def log_density(self, x: np.ndarray) -> float:
        p = len(self.scale)
        return float(self.df / 2 * np.linalg.slogdet(self.scale)[1] - self.df * p / 2 * math.log(2) - log_multigamma(self.df / 2, p) - (self.df + p + 1) / 2 * np.linalg.slogdet(x)[1] - 0.5 * np.trace(np.linalg.solve(x, self.scale)))

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """The inverse of a Wishart draw by its triangular root."""
        p = len(self.scale)
        a = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(self.df - np.arange(p))))
        m = np.linalg.solve(a, np.linalg.cholesky(self.scale).T)
        return m.T @ m


def wallenius(weights: np.ndarray, chosen: list[int]) -> float:
    """Chance that drawing one by one, in proportion to weights, gives exactly this set: an integral over [0, 1]."""
    w = np.asarray(weights, float)
    rest = w.sum() - w[chosen].sum()
    if rest <= 0:
        return 1.0
    t, g = gauss_legendre(120)
    u = (t + 1) / 2
    # the substitution t = u^m keeps the integrand smooth at 0
    m = max(1.0, math.ceil(2 * rest / max(w[chosen].min(), 1e-300))) if chosen else 1.0
    return float((g / 2 * m * u ** (m - 1) * np.prod([1 - u ** (m * x / rest) for x in w[chosen]], axis=0)).sum()) if chosen else 1.0


def interval_poincare(log_density, low: float, high: float, elements: int = 400) -> float:
    """The least constant C with Var f <= C E f'^2 under the density on [low, high]: one over the first gap of linear finite elements."""
    x = np.linspace(low, high, elements + 1)
    mid = (x[1:] + x[:-1]) / 2
    v = np.array([log_density(m) for m in mid])
    p, h = np.exp(v - v.max()), x[1] - x[0]
    k, m = np.zeros((elements + 1,) * 2), np.zeros((elements + 1,) * 2)
    for i in range(elements):
        k[i : i + 2, i : i + 2] += p[i] / h * np.array([[1, -1], [-1, 1]])
        m[i : i + 2, i : i + 2] += p[i] * h / 6 * np.array([[2, 1], [1, 2]])
    root = np.linalg.cholesky(m)
    a = np.linalg.solve(root, np.linalg.solve(root, k).T)
    return float(1 / np.linalg.eigvalsh((a + a.T) / 2)[1])


def tail_solve(log_tail, target: float, lo: float, hi: float, increasing: bool) -> float:
    """Where a log tail probability takes a value, by bisection and last a secant."""
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if (log_tail(mid) < target) == increasing else (lo, mid)
    return (lo + hi) / 2
