"""Spline bases and penalised fits from sums over rows, free knots and adaptive surfaces by reversible jumps (NumPy).

A penalised spline needs only the basis's Gram matrix, its products with the response and
the response's square, so those sums can come from a table of any size
(``operators.regression``). The samplers hold their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .linalg import Cholesky, spd_factor


# Bases

@dataclass(frozen=True)
class Knots:
    """Interior knots on [low, high] and a degree.

    The ends are repeated or, with ``extended``, even knots go on beyond them: then equal
    differences of coefficients are a polynomial, as difference penalties suppose.
    """

    interior: tuple[float, ...]
    low: float = 0.0
    high: float = 1.0
    degree: int = 3
    extended: bool = False

    @staticmethod
    def even(pieces: int, low: float, high: float, degree: int = 3, extended: bool = False) -> Knots:
        return Knots(tuple(np.linspace(low, high, pieces + 1)[1:-1].tolist()), low, high, degree, extended)

    @property
    def dimension(self) -> int:
        return len(self.interior) + self.degree + 1

    @property
    def places(self) -> np.ndarray:
        if self.extended:
            h = (self.high - self.low) / (len(self.interior) + 1)
            return self.low + h * np.arange(-self.degree, len(self.interior) + 2 + self.degree)
        return np.r_[[self.low] * (self.degree + 1), sorted(self.interior), [self.high] * (self.degree + 1)]


def spans(x: np.ndarray, k: Knots) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): each row's degree + 1 splines that are not zero, and the number of the first; x outside is moved to the end."""
    t, p = k.places, k.degree
    x = np.clip(np.asarray(x, float), k.low, k.high)
    at = np.clip(np.searchsorted(t, x, "right") - 1, p, len(t) - p - 2)
    b = np.zeros((len(x), p + 1))
    b[:, 0] = 1
    for d in range(1, p + 1):
        old = b.copy()
        b[:, : d + 1] = 0
        for j in range(d):
            left, right = t[at + 1 + j - d], t[at + 1 + j]
            share = np.divide(old[:, j], right - left, out=np.zeros(len(x)), where=right > left)
            b[:, j] += (right - x) * share
            b[:, j + 1] += (x - left) * share
    return at - p, b


def design(x: np.ndarray, k: Knots) -> np.ndarray:
    first, b = spans(x, k)
    out = np.zeros((len(b), k.dimension))
    rows = np.arange(len(b))
    for j in range(k.degree + 1):
        out[rows, first + j] += b[:, j]
    return out


def step_design(x: np.ndarray, interior: list[float]) -> np.ndarray:
    """One column a piece between knots."""
    return np.eye(len(interior) + 1)[np.searchsorted(np.sort(interior), np.asarray(x, float), "right")]


def banded_sums(x: np.ndarray, y: np.ndarray, k: Knots, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(lower bands of B'WB, B'Wy, y'Wy, sum of w)."""
    first, b = spans(x, k)
    w = np.ones(len(b)) if w is None else np.asarray(w, float)
    n, p = k.dimension, k.degree
    bands, r = np.zeros((p + 1, n)), np.zeros(n)
    for j in range(p + 1):
        r += np.bincount(first + j, w * b[:, j] * y, n)[:n]
        for i in range(p + 1 - j):
            bands[j] += np.bincount(first + i, w * b[:, i] * b[:, i + j], n)[:n]
    return bands, r, float((w * y * y).sum()), float(w.sum())


def unbanded(bands: np.ndarray) -> np.ndarray:
    n = bands.shape[1]
    a = np.zeros((n, n))
    for k, b in enumerate(bands):
        a += np.diag(b[: n - k], -k) + (np.diag(b[: n - k], k) if k else 0)
    return a


def difference(n: int, order: int = 2) -> np.ndarray:
    d = np.eye(n)
    for _ in range(order):
        d = np.diff(d, axis=0)
    return d


def penalty(n: int, order: int = 2) -> np.ndarray:
    """Squared differences of successive coefficients."""
    d = difference(n, order)
    return d.T @ d


# Penalised fits

@dataclass
class PenalisedFit:
    """A P-spline from B'B, B'y, y'y and the number of rows; ``order`` differences are penalised."""

    gram: np.ndarray
    cross: np.ndarray
    square: float
    rows: float
    order: int = 2

    def __post_init__(self):
        self.penalty = penalty(len(self.cross), self.order)
        self.rank = len(self.cross) - self.order
        w = np.linalg.eigvalsh(self.penalty)
        self.log_pseudo = float(np.log(w[self.order :]).sum())

    def factor(self, lam: float):
        return Cholesky(self.gram + lam * self.penalty)

    def coefficients(self, lam: float) -> np.ndarray:
        return self.factor(lam).solve(self.cross)

    def edf(self, lam: float) -> float:
        """Effective degrees of freedom: the trace of the smoother."""
        return float(np.trace(self.factor(lam).solve(self.gram)))

    def variance(self, lam: float) -> float:
        """The profiled residual variance."""
        b = self.coefficients(lam)
        return float(max(self.square - b @ self.cross, 1e-300) / max(self.rows - self.order, 1))

    def reml(self, lam: float) -> float:
        """Restricted log evidence, the noise variance profiled out."""
        f = self.factor(lam)
        return 0.5 * (self.rank * math.log(lam) + self.log_pseudo - f.log_determinant - (self.rows - self.order) * (math.log(2 * math.pi * self.variance(lam)) + 1))

    def best(self, low: float = 1e-8, high: float = 1e10) -> float:
        """The smoothing that maximises the restricted evidence: a grid in its logarithm, then golden sections."""
        grid = np.linspace(math.log(low), math.log(high), 60)
        v = [self.reml(math.exp(g)) for g in grid]
        k = int(np.argmax(v))
        a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        r = (math.sqrt(5) - 1) / 2
        for _ in range(60):
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if self.reml(math.exp(c)) >= self.reml(math.exp(d)) else (c, b)
        return math.exp((a + b) / 2)


@dataclass
class TensorFit:
    """A bivariate P-spline with a smoothing for each axis, from sums over the tensor basis (x's index runs slower)."""

    gram: np.ndarray
    cross: np.ndarray
    square: float
    rows: float
    nx: int
    ny: int
    order: int = 2
    px: np.ndarray = field(init=False)

    def __post_init__(self):
        ux, self.px = np.linalg.eigh(penalty(self.nx, self.order))
        uy, _ = np.linalg.eigh(penalty(self.ny, self.order))
        self.spectrum = np.maximum(ux, 0)[:, None], np.maximum(uy, 0)[None]  # both penalties share eigenvectors
        self.penalties = np.kron(penalty(self.nx, self.order), np.eye(self.ny)), np.kron(np.eye(self.nx), penalty(self.ny, self.order))
        self.null = self.order**2

    def factor(self, lx: float, ly: float):
        return Cholesky(self.gram + lx * self.penalties[0] + ly * self.penalties[1])

    def coefficients(self, lx: float, ly: float) -> np.ndarray:
        return self.factor(lx, ly).solve(self.cross)

    def log_pseudo_determinant(self, lx: float, ly: float) -> float:
        s = np.sort((lx * self.spectrum[0] + ly * self.spectrum[1]).ravel())[self.null :]
        return float(np.log(s).sum())

    def variance(self, lx: float, ly: float) -> float:
        return float(max(self.square - self.coefficients(lx, ly) @ self.cross, 1e-300) / max(self.rows - self.null, 1))

    def reml(self, lx: float, ly: float) -> float:
        return 0.5 * (self.log_pseudo_determinant(lx, ly) - self.factor(lx, ly).log_determinant - (self.rows - self.null) * (math.log(2 * math.pi * self.variance(lx, ly)) + 1))

    def best(self, low: float = 1e-6, high: float = 1e8, steps: int = 9, rounds: int = 5) -> tuple[float, float]:
        """A grid over both logarithms, refined around its best cell."""
        gx = gy = np.linspace(math.log(low), math.log(high), steps)
        for _ in range(rounds):
            v = np.array([[self.reml(math.exp(a), math.exp(b)) for b in gy] for a in gx])
            i, j = np.unravel_index(int(v.argmax()), v.shape)
            wx, wy = (gx[1] - gx[0]), (gy[1] - gy[0])
            bx, by = float(gx[i]), float(gy[j])
            gx, gy = np.linspace(bx - wx, bx + wx, steps), np.linspace(by - wy, by + wy, steps)
        return math.exp(bx), math.exp(by)


def tensor_design(x: np.ndarray, kx: Knots, y: np.ndarray, ky: Knots) -> np.ndarray:
    return np.einsum("ni,nj->nij", design(x, kx), design(y, ky)).reshape(len(np.atleast_1d(x)), -1)


# Knot-count priors (log, up to a constant)

def uniform_prior(most: int):
    return lambda k: 0.0 if 0 <= k <= most else -math.inf


def poisson_prior(mean: float):
    return lambda k: k * math.log(mean) - math.lgamma(k + 1)


def conway_prior(mean: float, nu: float):
    return lambda k: nu * (k * math.log(mean) - math.lgamma(k + 1))


def ebic_prior(sites: int, gamma: float = 1.0):
    return lambda k: -gamma * (math.lgamma(sites + 1) - math.lgamma(k + 1) - math.lgamma(sites - k + 1)) if 0 <= k <= sites else -math.inf


def g_marginal(gram: np.ndarray, cross: np.ndarray, square: float, rows: float, g: float | None = None) -> tuple[float, np.ndarray, float]:
    """(log evidence, mean coefficients, residual sum) under a g-prior of unit information and a Jeffreys noise variance; -inf where the design is close to singular."""
    g = g or max(rows, 2.0)
    try:
        f = Cholesky(gram)
    except np.linalg.LinAlgError:
        return -math.inf, np.zeros(len(cross)), square
    if f.relative_pivot < 1e-9:
        return -math.inf, np.zeros(len(cross)), square
    b = f.solve(cross)
    rest = max(square - g / (1 + g) * float(b @ cross), 1e-300)
    return -0.5 * len(cross) * math.log1p(g) - 0.5 * rows * math.log(rest), g / (1 + g) * b, rest


# Free knots

@dataclass
class FreeKnots:
    """Free-knot regression by birth, death and relocation of knots.

    A knot is born at a draw around an existing one (or uniformly) and the acceptance
    accounts for both ways; ``weights`` give rows their own precision, as the scale mixture of
    a Student law redraws them (``df``).
    """

    x: np.ndarray
    y: np.ndarray
    prior: object = None
    degree: int = 3
    most: int = 60
    spread: float = 0.05
    df: float | None = None
    seed: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.x, self.y = np.asarray(self.x, float), np.asarray(self.y, float)
        self.low, self.high = float(self.x.min()), float(self.x.max())
        self.prior = self.prior or poisson_prior(4.0)
        self.knots: list[float] = []
        self.w = np.ones(len(self.x))
        self.tries, self.taken = dict.fromkeys(("birth", "death", "move"), 0), dict.fromkeys(("birth", "death", "move"), 0)
        self.now = self._fit(self.knots)

    def _fit(self, knots: list[float]):
        k = Knots(tuple(sorted(knots)), self.low, self.high, self.degree)
        bands, cross, square, _ = banded_sums(self.x, self.y, k, self.w)
        e, b, rest = g_marginal(unbanded(bands), cross, square, len(self.x))
        return e + self.prior(len(knots)), k, b, rest, bands

    def _density(self, at: float, centres: list[float]) -> float:
        """Of a birth: half uniform, half a normal around each centre, cut to the range."""
        span = self.high - self.low
        s = self.spread * span
        u = 1 / span
        if not centres:
            return u
        total = 0.0
        for c in centres:
            mass = 0.5 * (math.erf((self.high - c) / (s * math.sqrt(2))) - math.erf((self.low - c) / (s * math.sqrt(2))))
            total += math.exp(-0.5 * ((at - c) / s) ** 2) / (s * math.sqrt(2 * math.pi)) / mass
        return 0.5 * u + 0.5 * total / len(centres)

    def _place(self, centres: list[float]) -> float:
        if not centres or self.rng.random() < 0.5:
            return float(self.rng.uniform(self.low, self.high))
        c = centres[self.rng.integers(len(centres))]
        while True:
            at = float(c + self.spread * (self.high - self.low) * self.rng.standard_normal())
            if self.low < at < self.high:
                return at

    def step(self) -> None:
        n = len(self.knots)
        kind = ("birth", "death", "move")[self.rng.choice(3, p=[0.4, 0.4, 0.2])]
        self.tries[kind] += 1
        if kind == "birth":
            if n >= self.most:
                return
            at = self._place(self.knots)
            new = [*self.knots, at]
            # a death picks one of n + 1; the order of knots does not matter
            ratio = -math.log(n + 1) - math.log(self._density(at, self.knots)) + math.log(n + 1) - math.log(self.high - self.low)
        elif kind == "death":
            if not n:
                return
            j = int(self.rng.integers(n))
            new = self.knots[:j] + self.knots[j + 1 :]
            ratio = math.log(n) + math.log(self._density(self.knots[j], new)) - math.log(n) + math.log(self.high - self.low)
        else:
            if not n:
                return
            j = int(self.rng.integers(n))
            rest = self.knots[:j] + self.knots[j + 1 :]
            at = self._place([self.knots[j]])
            new = [*rest, at]
            ratio = math.log(self._density(self.knots[j], [at])) - math.log(self._density(at, [self.knots[j]]))
        fit = self._fit(new)
        if math.log(max(self.rng.random(), 1e-300)) < fit[0] - self.now[0] + ratio:
            self.knots, self.now = new, fit
            self.taken[kind] += 1

    def draw(self) -> tuple[Knots, np.ndarray, float]:
        """Knots, coefficients and noise variance from their joint posterior given the knots."""
        _, k, mean, rest, bands = self.now
        n = len(self.x)
        sigma2 = float(rest / 2 / self.rng.gamma(n / 2))
        g = n / (1 + n)
        return k, mean + math.sqrt(sigma2 * g) * spd_factor(unbanded(bands)).sample_inverse(self.rng), sigma2

    def reweigh(self) -> None:
        """Rows' precisions given residuals, for Student noise."""
        k, b, s2 = self.draw()
        r = self.y - design(self.x, k) @ b
        self.w = self.rng.gamma((self.df + 1) / 2, 2 / (self.df + r * r / s2))
        self.now = self._fit(self.knots)

    def run(self, burn: int, keep: int, grid: np.ndarray) -> dict:
        """Curves at ``grid`` for each kept draw, knot counts, noise variances and acceptance rates."""
        curves, counts, noise = [], [], []
        for i in range(burn + keep):
            self.step()
            if self.df is not None and i % 10 == 9:
                self.reweigh()
            if i >= burn:
                k, b, s2 = self.draw()
                curves.append(design(grid, k) @ b)
                counts.append(len(self.knots))
                noise.append(s2)
        return {"curves": np.array(curves), "knots": np.array(counts), "sigma2": np.array(noise), "rates": {m: self.taken[m] / max(self.tries[m], 1) for m in self.tries}}


def extrema(k: Knots, coefficients: np.ndarray, steps: int = 512) -> tuple[float, float]:
    """(place, height) of a spline's maximum: the best of a grid, then golden sections beside it."""
    f = lambda t: float((design(np.array([t]), k) @ coefficients)[0])
    grid = np.linspace(k.low, k.high, steps)
    j = int((design(grid, k) @ coefficients).argmax())
    a, b = grid[max(j - 1, 0)], grid[min(j + 1, steps - 1)]
    r = (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if f(c) >= f(d) else (c, b)
    t = (a + b) / 2
    return float(t), f(t)


# Adaptive surfaces

@dataclass(frozen=True)
class Term:
    """A product of hinges (variable, sign, knot) on inputs in [0, 1], scaled to at most 1."""

    hinges: tuple[tuple[int, int, float], ...]

    def column(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x))
        for v, s, t in self.hinges:
            out = out * np.maximum(s * (x[:, v] - t), 0) / max(s * ((1 + s) / 2 - t), 1e-12)
        return out

    def slope(self, x: np.ndarray, variable: int) -> np.ndarray:
        """The derivative by one input; 0 where the term does not hold it."""
        if all(v != variable for v, _, _ in self.hinges):
            return np.zeros(len(x))
        out = np.ones(len(x))
        for v, s, t in self.hinges:
            size = max(s * ((1 + s) / 2 - t), 1e-12)
            out = out * (np.where(s * (x[:, v] - t) > 0, s, 0.0) / size if v == variable else np.maximum(s * (x[:, v] - t), 0) / size)
        return out


@dataclass
class Surface:
    """Bayesian adaptive regression splines: terms enter, leave and change by reversible jumps.

    The number of terms has a Poisson prior whose mean has a gamma one; orders, variables, signs
    and knots (observed values) are uniform. The evidence of a set of terms is that of a
    g-prior, from sums that a birth or death only borders.
    """

    x: np.ndarray
    y: np.ndarray
    order: int = 2
    most: int = 50
    seed: int = 0
    shape: float = 10.0
    rate: float = 10.0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        x = np.asarray(self.x, float)
        self.offset, span = x.min(0), np.ptp(x, 0)
        self.scale = np.where(span > 0, span, 1.0)
        self.u, self.y = (x - self.offset) / self.scale, np.asarray(self.y, float)
        self.centre = float(self.y.mean())
        self.p, self.order = x.shape[1], min(self.order, x.shape[1])
        self.terms: list[Term] = []
        self.columns = np.ones((len(x), 1))
        self.mean_terms = self.shape / self.rate
        self.now = self._evidence(self.columns)
        self.accepted = dict.fromkeys(("birth", "death", "change"), 0)

    def _evidence(self, columns: np.ndarray):
        y = self.y - self.centre
        return g_marginal(columns.T @ columns, columns.T @ y, float(y @ y), len(y))

    def _random(self) -> Term:
        k = int(self.rng.integers(1, self.order + 1))
        v = np.sort(self.rng.choice(self.p, k, replace=False))
        return Term(tuple((int(i), int(self.rng.choice([-1, 1])), float(self.u[self.rng.integers(len(self.u)), i])) for i in v))

    def step(self) -> None:
        n = len(self.terms)
        kind = ("birth", "death", "change")[self.rng.integers(3)]
        # the proposal is the prior of a term, so the prior's terms cancel but for the count
        if kind == "birth" and n < self.most:
            t = self._random()
            c = t.column(self.u)
            if np.count_nonzero(c) < 3:
                return
            terms, columns, ratio = [*self.terms, t], np.c_[self.columns, c], math.log(self.mean_terms / (n + 1))
        elif kind == "death" and n:
            j = int(self.rng.integers(n))
            terms, columns, ratio = self.terms[:j] + self.terms[j + 1 :], np.delete(self.columns, j + 1, 1), math.log(n / self.mean_terms)
        elif kind == "change" and n:
            j = int(self.rng.integers(n))
            h = list(self.terms[j].hinges)
            i = int(self.rng.integers(len(h)))
            h[i] = (h[i][0], int(self.rng.choice([-1, 1])), float(self.u[self.rng.integers(len(self.u)), h[i][0]]))
            t = Term(tuple(h))
            c = t.column(self.u)
            if np.count_nonzero(c) < 3:
                return
            terms, columns, ratio = list(self.terms), self.columns.copy(), 0.0
            terms[j], columns[:, j + 1] = t, c
        else:
            return
        new = self._evidence(columns)
        if math.log(max(self.rng.random(), 1e-300)) < new[0] - self.now[0] + ratio:
            self.terms, self.columns, self.now = terms, columns, new
            self.accepted[kind] += 1
        self.mean_terms = float(self.rng.gamma(self.shape + len(self.terms)) / (self.rate + 1))

    def draw(self) -> tuple[list[Term], np.ndarray, float]:
        _, mean, rest = self.now
        n = len(self.y)
        s2 = float(rest / 2 / self.rng.gamma(n / 2))
        b = mean + math.sqrt(s2 * n / (1 + n)) * Cholesky(self.columns.T @ self.columns).sample_inverse(self.rng)
        b[0] += self.centre
        return list(self.terms), b, s2

    def run(self, burn: int, keep: int, thin: int = 1) -> list[tuple[list[Term], np.ndarray, float]]:
        out = []
        for i in range(burn + keep * thin):
            self.step()
            if i >= burn and (i - burn) % thin == 0:
                out.append(self.draw())
        return out

    def predict(self, draws: list, x: np.ndarray) -> np.ndarray:
        """(draw, row) means."""
        u = (np.asarray(x, float) - self.offset) / self.scale
        return np.array([b[0] + sum((c * t.column(u) for c, t in zip(b[1:], terms, strict=True)), np.zeros(len(u))) for terms, b, _ in draws])

    def gradient(self, draws: list, x: np.ndarray) -> np.ndarray:
        """(draw, row, input) slopes in the inputs' own units."""
        u = (np.asarray(x, float) - self.offset) / self.scale
        return np.array([np.stack([sum((c * t.slope(u, v) for c, t in zip(b[1:], terms, strict=True)), np.zeros(len(u))) / self.scale[v] for v in range(self.p)], 1) for terms, b, _ in draws])

    def sobol(self, draws: list) -> tuple[np.ndarray, np.ndarray]:
        """(main, total) variance shares of each input for each draw, exactly, for independent uniform inputs."""
        main, total = [], []
        for terms, b, _ in draws:
            m, t = sobol_indices(terms, b[1:], self.p)
            main.append(m)
            total.append(t)
        return np.array(main), np.array(total)

    def active_subspace(self, draws: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues, directions by column) of the mean outer product of gradients over draws and rows, inputs scaled to [0, 1]."""
        g = self.gradient(draws, x) * self.scale
        c = np.einsum("drp,drq->pq", g, g) / (g.shape[0] * g.shape[1])
        w, v = np.linalg.eigh(c)
        return w[::-1], v[:, ::-1]


def hinge_mean(s: int, t: float) -> float:
    """Mean of the scaled hinge over [0, 1]."""
    size = max(s * ((1 + s) / 2 - t), 1e-12)
    return size * size / 2 / size


def hinge_pair(s: int, t: float, r: int, q: float) -> float:
    """Mean of the product of two scaled hinges of one input."""
    a, b = max(s * ((1 + s) / 2 - t), 1e-12), max(r * ((1 + r) / 2 - q), 1e-12)
    lo = max([0.0] + [k for sign, k in ((s, t), (r, q)) if sign > 0])
    hi = min([1.0] + [k for sign, k in ((s, t), (r, q)) if sign < 0])
    if hi <= lo:
        return 0.0
    f = lambda x: s * r * (x**3 / 3 - (t + q) * x * x / 2 + t * q * x)
    return (f(hi) - f(lo)) / (a * b)


def sobol_indices(terms: list[Term], c: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(main, total) from products of one-input integrals: Var E[f | x_v] and 1 - Var E[f | others]."""
    if not terms:
        return np.zeros(p), np.zeros(p)
    n = len(terms)
    of = [{v: (s, t) for v, s, t in term.hinges} for term in terms]
    mean = np.array([[hinge_mean(*o[v]) if v in o else 1.0 for v in range(p)] for o in of])
    pair = np.ones((n, n, p))
    for i in range(n):
        for j in range(n):
            for v in range(p):
                a, b = of[i].get(v), of[j].get(v)
                pair[i, j, v] = hinge_pair(*a, *b) if a and b else hinge_mean(*(a or b)) if a or b else 1.0
    apart = mean[:, None] * mean[None]
    cc = np.outer(c, c)
    zero = (cc * apart.prod(2)).sum()
    every = (cc * pair.prod(2)).sum() - zero
    if every <= 0:
        return np.zeros(p), np.zeros(p)
    main = np.array([(cc * pair[:, :, v] * np.delete(apart, v, 2).prod(2)).sum() - zero for v in range(p)])
    rest = np.array([(cc * apart[:, :, v] * np.delete(pair, v, 2).prod(2)).sum() - zero for v in range(p)])
    return main / every, 1 - rest / every


def posterior_summary(values: np.ndarray, weights: np.ndarray | None = None, probabilities: tuple[float, ...] = (0.025, 0.5, 0.975)) -> dict:
    """Mean, standard deviation and quantiles of draws, weighted if asked for."""
    v = np.asarray(values, float)
    w = np.full(len(v), 1 / len(v)) if weights is None else np.asarray(weights, float) / np.sum(weights)
    order = np.argsort(v, kind="stable")
    c = np.cumsum(w[order])
    m = float(w @ v)
    return {"mean": m, "sd": float(math.sqrt(max(w @ (v - m) ** 2, 0))), "quantiles": [float(v[order][min(int(np.searchsorted(c, p - 1e-12)), len(v) - 1)]) for p in probabilities]}


def mixture_quantile(means: np.ndarray, sds: np.ndarray, probability: float, weights: np.ndarray | None = None) -> float:
    """Quantile of a mixture of normals, bisected between its components' extremes."""
    w = np.full(len(means), 1 / len(means)) if weights is None else np.asarray(weights) / np.sum(weights)
    lo, hi = float((means - 12 * sds).min()), float((means + 12 * sds).max())
    for _ in range(200):
        mid = (lo + hi) / 2
        p = sum(a * 0.5 * (1 + math.erf((mid - m) / (s * math.sqrt(2)))) for a, m, s in zip(w, means, sds, strict=True))
        lo, hi = (mid, hi) if p < probability else (lo, mid)
    return (lo + hi) / 2
