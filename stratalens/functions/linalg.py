"""Dense and structured linear algebra for the kernels that run inside tasks (NumPy).

What is distributed (Gram matrices, products, spectra of tables) is in ``operators.linalg``;
here are the factors and solvers that a task or the driver applies to matrices of bounded
size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np

_counts: list[Counter] = []


@contextmanager
def counting() -> Iterator[Counter]:
    """Counts the factorisations made inside the block, by kind."""
    c: Counter = Counter()
    _counts.append(c)
    try:
        yield c
    finally:
        _counts.remove(c)


def _note(kind: str) -> None:
    for c in _counts:
        c[kind] += 1


class Cholesky:
    """Factor of a symmetric positive definite matrix; ``relative_pivot`` is the least pivot over its diagonal."""

    def __init__(self, a: np.ndarray):
        _note("cholesky")
        self.a = np.asarray(a, float)
        self.l = np.linalg.cholesky(self.a)
        self.relative_pivot = float((np.diag(self.l) ** 2 / np.diag(self.a)).min()) if len(self.a) else 1.0

    @property
    def log_determinant(self) -> float:
        return float(2 * np.log(np.diag(self.l)).sum())

    def whiten(self, b: np.ndarray) -> np.ndarray:
        return forward(self.l, b)

    def solve(self, b: np.ndarray) -> np.ndarray:
        return backward(self.l, forward(self.l, b))

    def inverse_quadratic_form(self, b: np.ndarray) -> float:
        z = self.whiten(b)
        return float(z @ z)

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        """A draw from N(0, A)."""
        return self.l @ rng.standard_normal(len(self.l))

    def sample_inverse(self, rng: np.random.Generator) -> np.ndarray:
        """A draw from N(0, A^-1)."""
        return backward(self.l, rng.standard_normal(len(self.l)))

    def condition(self) -> float:
        return condition(self.a, self.solve)


def forward(l: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L x = b by rows."""
    x = np.array(b, float)
    for i in range(len(l)):
        x[i] = (x[i] - l[i, :i] @ x[:i]) / l[i, i]
    return x


def backward(l: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L' x = b by rows, from the last."""
    x = np.array(b, float)
    for i in range(len(l) - 1, -1, -1):
        x[i] = (x[i] - l[i + 1 :, i] @ x[i + 1 :]) / l[i, i]
    return x


def condition(a: np.ndarray, solve: Callable[[np.ndarray], np.ndarray]) -> float:
    """1-norm condition of D A D with a unit diagonal; the inverse's norm is estimated by Hager's ascent on its columns."""
    d = 1 / np.sqrt(np.diag(a))
    norm = np.abs(d[:, None] * a * d[None]).sum(0).max()
    inverse = lambda v: solve(v / d) / d
    x, best, tried = np.full(len(a), 1 / len(a)), 0.0, set()
    for _ in range(8):
        y = inverse(x)
        best = max(best, float(np.abs(y).sum()))
        z = inverse(np.where(y >= 0, 1.0, -1.0))  # symmetric
        j = int(np.abs(z).argmax())
        if j in tried or abs(z[j]) <= z @ x:
            break
        tried.add(j)
        x = np.eye(len(a))[j]
    return float(norm * best)


class BandCholesky:
    """A = L D L' of a matrix with ``half`` diagonals beside the main one, given as lower bands (band k holds A[i + k, i])."""

    def __init__(self, bands: np.ndarray):
        _note("band")
        a = np.array(bands, float)
        self.half, self.n = len(a) - 1, a.shape[1]
        self.l, self.d = np.zeros_like(a), np.zeros(self.n)
        for i in range(self.n):
            self.d[i] = a[0, i]
            if not self.d[i] > 0:
                raise np.linalg.LinAlgError("not positive definite")
            m = min(self.half, self.n - 1 - i)
            c = a[1 : m + 1, i] / self.d[i]
            self.l[1 : m + 1, i] = c
            for k in range(m):  # what is left below
                a[: m - k, i + 1 + k] -= c[k] * c[k:] * self.d[i]

    @staticmethod
    def of(a: np.ndarray, half: int) -> BandCholesky:
        return BandCholesky(np.array([np.r_[np.diag(a, -k), np.zeros(k)] for k in range(half + 1)]))

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = np.array(b, float)
        for i in range(self.n):
            m = min(self.half, self.n - 1 - i)
            x[i + 1 : i + 1 + m] -= np.multiply.outer(self.l[1 : m + 1, i], x[i])
        x = (x.T / self.d).T
        return self._up(x)

    def _up(self, x: np.ndarray) -> np.ndarray:
        for i in range(self.n - 1, -1, -1):
            m = min(self.half, self.n - 1 - i)
            x[i] -= self.l[1 : m + 1, i] @ x[i + 1 : i + 1 + m]
        return x

    @property
    def log_determinant(self) -> float:
        return float(np.log(self.d).sum())

    def sample_inverse(self, rng: np.random.Generator) -> np.ndarray:
        return self._up(rng.standard_normal(self.n) / np.sqrt(self.d))


def spd_factor(a: np.ndarray, half: int | None = None):
    """A band factor where the bands are a quarter of the order or fewer, a dense one otherwise."""
    return BandCholesky.of(a, half) if half is not None and 4 * half <= len(a) else Cholesky(a)


class BorderedCholesky:
    """A factor that rows enter and leave; a proposal is priced before it is accepted."""

    def __init__(self, a: np.ndarray):
        self.l = Cholesky(a).l if len(a) else np.zeros((0, 0))
        self.next: np.ndarray | None = None

    def birth(self, column: np.ndarray, diagonal: float) -> float:
        """Proposes a last row; returns its squared pivot, the ratio of determinants (not positive: refused)."""
        w = forward(self.l, column)
        pivot = float(diagonal - w @ w)
        if pivot > 0:
            n = len(self.l)
            self.next = np.zeros((n + 1, n + 1))
            self.next[:n, :n], self.next[n, :n], self.next[n, n] = self.l, w, math.sqrt(pivot)
        else:
            self.next = None
        return pivot

    def death(self, k: int) -> float:
        """Proposes that row k leaves; returns the ratio of determinants."""
        rest = np.delete(self.l, k, 0)
        low, gone = rest[k:, k:], None
        block, x = np.delete(low, 0, 1) if len(low) else np.zeros((0, 0)), low[:, 0].copy() if len(low) else np.zeros(0)
        block = block.copy()
        for i in range(len(x)):  # add the lost column's outer product to the block behind
            r = math.hypot(block[i, i], x[i])
            c, s = r / block[i, i], x[i] / block[i, i]
            block[i, i] = r
            block[i + 1 :, i] = (block[i + 1 :, i] + s * x[i + 1 :]) / c
            x[i + 1 :] = c * x[i + 1 :] - s * block[i + 1 :, i]
        del gone
        out = np.zeros((len(rest), len(rest)))
        out[:, :k] = rest[:, :k]
        out[k:, k:] = block
        self.next = out
        return float(np.prod(np.diag(out)) ** 2 / np.prod(np.diag(self.l)) ** 2)

    def change(self, k: int, column: np.ndarray, diagonal: float) -> float:
        """Proposes other entries in row k, which becomes the last; returns the ratio of determinants (not positive: refused). ``column`` is without row k."""
        old = self.l
        gone = self.death(k)
        self.l = self.next
        pivot = self.birth(column, diagonal)
        self.l = old
        return gone * pivot

    def accept(self) -> None:
        if self.next is None:
            raise ValueError("nothing to accept")
        self.l, self.next = self.next, None

    def whiten(self, b: np.ndarray, proposed: bool = False) -> np.ndarray:
        return forward(self.next if proposed else self.l, b)


class PivotedCholesky:
    """P'AP = LL' of a semidefinite matrix, stopped at pivots below ``tolerance`` of the first: ``rank`` columns."""

    def __init__(self, a: np.ndarray, tolerance: float = 1e-12):
        _note("pivoted")
        a = np.array(a, float)
        n = len(a)
        d, order, rows = np.diag(a).copy(), np.arange(n), np.zeros((n, n))
        top, self.rank = max(d.max(), 0.0) if n else 0.0, 0
        for k in range(n):
            j = k + int(d[order[k:]].argmax())
            order[[k, j]] = order[[j, k]]
            p = order[k]
            if d[p] <= tolerance * top or top == 0:
                break
            rows[p, k] = math.sqrt(d[p])
            rest = order[k + 1 :]
            rows[rest, k] = (a[rest, p] - rows[rest, :k] @ rows[p, :k]) / rows[p, k]
            d[rest] -= rows[rest, k] ** 2
            self.rank += 1
        if self.rank < n and d[order[self.rank :]].min(initial=0.0) < -1e-8 * max(top, 1e-300):
            raise np.linalg.LinAlgError("indefinite")
        self.order, self.loading = order, rows[:, : self.rank]


class DiagonalPlusLowRank:
    """diag(d) + U U' by Woodbury's identity."""

    def __init__(self, d: np.ndarray, u: np.ndarray):
        self.d, self.u = np.asarray(d, float), np.asarray(u, float)
        self.core = Cholesky(np.eye(self.u.shape[1]) + (self.u.T / self.d) @ self.u)

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b / self.d
        return x - (self.u @ self.core.solve(self.u.T @ x)) / self.d

    def inverse_quadratic_form(self, b: np.ndarray) -> float:
        return float(b @ self.solve(b))

    @property
    def log_determinant(self) -> float:
        return float(np.log(self.d).sum()) + self.core.log_determinant

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        return np.sqrt(self.d) * rng.standard_normal(len(self.d)) + self.u @ rng.standard_normal(self.u.shape[1])


# Spectra

def jacobi_eigen(a: np.ndarray, sweeps: int = 60, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and columns of eigenvectors of a symmetric matrix, by rotations."""
    a, n = np.array(a, float), len(a)
    v = np.eye(n)
    scale = np.linalg.norm(a) or 1.0
    for _ in range(sweeps):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= tolerance * scale:
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= 1e-300:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.hypot(theta, 1))
                c = 1 / math.hypot(t, 1)
                s = t * c
                r = np.array([[c, s], [-s, c]])
                a[:, [p, q]] = a[:, [p, q]] @ r
                a[[p, q]] = r.T @ a[[p, q]]
                v[:, [p, q]] = v[:, [p, q]] @ r
    order = np.argsort(np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def eigen(a: np.ndarray, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and columns, rotations for small matrices, LAPACK beyond; each column's largest entry is positive."""
    _note("eigen")
    w, v = jacobi_eigen(a) if len(a) <= small else np.linalg.eigh(a)
    return w, oriented(v)


def oriented(v: np.ndarray) -> np.ndarray:
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1.0, 1.0)


def bottom_k(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w, v = eigen(a)
    return w[:k], v[:, :k]


def lobpcg(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, largest: bool = False, precondition: Callable | None = None, constraints: np.ndarray | None = None, rounds: int = 300, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(eigenvalues, columns, converged): the k ends of a symmetric operator's spectrum by blocks of iterates, residuals and directions.

    ``constraints`` are orthonormal columns to stay away from (a known null space).
    """
    rng = np.random.default_rng(seed)
    away = (lambda x: x - constraints @ (constraints.T @ x)) if constraints is not None else (lambda x: x)
    x, _ = np.linalg.qr(away(rng.standard_normal((n, min(k + 2, n)))))
    p = np.zeros((n, 0))
    values = np.zeros(x.shape[1])
    for _ in range(rounds):
        ax = apply(x)
        small = x.T @ ax
        w, c = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-w if largest else w)
        values, x, ax = w[order], x @ c[:, order], ax @ c[:, order]
        r = ax - x * values
        if np.linalg.norm(r[:, :k], axis=0).max() <= tolerance * max(1.0, np.abs(values[:k]).max()):
            return values[:k], oriented(x[:, :k]), True
        z = away(precondition(r) if precondition else r)
        basis, _ = np.linalg.qr(np.c_[x, z, p])
        ab = apply(basis)
        small = basis.T @ ab
        w, c = np.linalg.eigh((small + small.T) / 2)
        pick = c[:, np.argsort(-w if largest else w)[: x.shape[1]]]
        new = basis @ pick
        p, _ = np.linalg.qr(away(new - x @ (x.T @ new)))
        x, _ = np.linalg.qr(away(new))
    return values[:k], oriented(x[:, :k]), False


def thin_svd(a: np.ndarray, sweeps: int = 60, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, s, V') by rotating pairs of columns until they are orthogonal; s falls."""
    _note("svd")
    a = np.array(a, float)
    if a.shape[0] < a.shape[1]:
        v, s, u = thin_svd(a.T, sweeps, tolerance)
        return u.T, s, v.T
    n = a.shape[1]
    v = np.eye(n)
    for _ in range(sweeps):
        done = True
        for p in range(n - 1):
            for q in range(p + 1, n):
                x, y, z = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if abs(z) <= tolerance * math.sqrt(x * y) or z == 0:
                    continue
                done = False
                theta = (y - x) / (2 * z)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + math.hypot(theta, 1))
                c = 1 / math.hypot(t, 1)
                r = np.array([[c, c * t], [-c * t, c]])
                a[:, [p, q]] = a[:, [p, q]] @ r
                v[:, [p, q]] = v[:, [p, q]] @ r
        if done:
            break
    s = np.linalg.norm(a, axis=0)
    order = np.argsort(-s, kind="stable")
    s, v, a = s[order], v[:, order], a[:, order]
    u = np.divide(a, s, out=np.zeros_like(a), where=s > 0)
    return u, s, v.T


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ascending angles between the column spaces; small ones from sines, so that they stay exact."""
    p, _ = np.linalg.qr(a)
    q, _ = np.linalg.qr(b)
    if p.shape[1] < q.shape[1]:
        p, q = q, p
    c = np.clip(np.linalg.svd(p.T @ q, compute_uv=False), 0, 1)
    s = np.sort(np.clip(np.linalg.svd(q - p @ (p.T @ q), compute_uv=False), 0, 1))[: len(c)]
    return np.sort(np.where(c**2 > 0.5, np.arcsin(s), np.arccos(c)))


def orthonormal(a: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Columns made orthonormal one behind another, twice; dependent ones are dropped."""
    out: list[np.ndarray] = []
    for v in np.asarray(a, float).T:
        w = v.copy()
        for _ in range(2):
            for u in out:
                w -= (u @ w) * u
        size = np.linalg.norm(w)
        if size > tolerance * max(np.linalg.norm(v), 1e-300):
            out.append(w / size)
    return np.array(out).T if out else np.zeros((len(a), 0))


def symmetric_function(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    w, v = eigen(a)
    return (v * f(w)) @ v.T


def rotation(skew: np.ndarray) -> np.ndarray:
    """exp of a skew matrix: it is normal, so its Hermitian twin's spectrum gives it."""
    w, v = np.linalg.eigh(1j * np.asarray(skew, float))
    return np.real((v * np.exp(-1j * w)) @ v.conj().T)


def rotation_log(r: np.ndarray) -> np.ndarray:
    """The skew matrix of least angles whose exponential is ``r``; a half turn has no single one and is refused."""
    w, v = np.linalg.eig(np.asarray(r, float))
    angle = np.angle(w)
    if np.abs(np.abs(angle) - math.pi).min(initial=1.0) < 1e-9:
        raise ValueError("a half turn has no single logarithm")
    s = np.real((v * (1j * angle)) @ np.linalg.inv(v))
    return (s - s.T) / 2


# Sums, products, transforms

def pairwise_sum(x: np.ndarray) -> float:
    """Halves added up: errors grow with the logarithm of the length."""
    x = np.asarray(x, float)
    while len(x) > 1:
        odd = x[-1:] if len(x) % 2 else x[:0]
        x = np.r_[x[0 : len(x) - len(odd) : 2] + x[1 : len(x) - len(odd) : 2], odd]
    return float(x[0]) if len(x) else 0.0


def pairwise_dot(x: np.ndarray, y: np.ndarray) -> float:
    return pairwise_sum(np.asarray(x, float) * np.asarray(y, float))


def fft(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Radix-2 transform of a length that is a power of two; the inverse divides by the length."""
    x = np.asarray(x, complex)
    n = len(x)
    if n & (n - 1) or not n:
        raise ValueError("the length must be a power of two")
    bits = n.bit_length() - 1
    at = np.arange(n)
    turned = np.zeros(n, int)
    for k in range(bits):
        turned |= ((at >> k) & 1) << (bits - 1 - k)
    x = x[turned]
    size = 2
    while size <= n:
        w = np.exp((2j if inverse else -2j) * math.pi * np.arange(size // 2) / size)
        b = x.reshape(-1, size)
        even, odd = b[:, : size // 2], b[:, size // 2 :] * w
        x = np.concatenate([even + odd, even - odd], 1).ravel()
        size *= 2
    return x / n if inverse else x


def fft_nd(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    x = np.asarray(x, complex)
    for axis in range(x.ndim):
        x = np.apply_along_axis(fft, axis, x, inverse)
    return x


def khatri_rao_gram(a: np.ndarray, h: np.ndarray, inner: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the columns a_j (x) h_j without building them: entries of A'A times those of H'MH."""
    m = h.T @ (h if inner is None else inner @ h)
    return (a.T @ a) * m


def face_splitting_gram(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gram matrix of the rows' outer products, (columns of a x columns of h) squared."""
    p, q = a.shape[1], h.shape[1]
    return np.einsum("ni,nj,nk,nl->ijkl", a, h, a, h, optimize=True).reshape(p * q, p * q)


def ica(x: np.ndarray, k: int, symmetric: bool = False, rounds: int = 200, tolerance: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(sources, unmixing) of centred and whitened rows, by the fixed point of tanh; deflation or all at once."""
    x = np.asarray(x, float) - np.mean(x, 0)
    w, v = np.linalg.eigh(x.T @ x / len(x))
    order = np.argsort(-w)[:k]
    white = v[:, order] / np.sqrt(w[order])
    z = x @ white
    rng = np.random.default_rng(seed)

    def step(u: np.ndarray) -> np.ndarray:
        g = np.tanh(z @ u.T)
        return (g.T @ z) / len(z) - (1 - g**2).mean(0)[:, None] * u

    if symmetric:
        u = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds):
            p, _, q = np.linalg.svd(step(u))
            new = p @ q
            done = np.abs(np.abs((new * u).sum(1)) - 1).max() < tolerance
            u = new
            if done:
                break
    else:
        u = np.zeros((k, k))
        for i in range(k):
            one = rng.standard_normal(k)
            for _ in range(rounds):
                one -= u[:i].T @ (u[:i] @ one)
                one /= np.linalg.norm(one)
                new = step(one[None])[0]
                new -= u[:i].T @ (u[:i] @ new)
                new /= np.linalg.norm(new)
                done = abs(abs(new @ one) - 1) < tolerance
                one = new
                if done:
                    break
            u[i] = one
    unmixing = u @ white.T
    return x @ unmixing.T, unmixing


class OnlineMahalanobis:
    """Running mean and variance of each coordinate, and the scaled distance of a row from them; mergeable."""

    def __init__(self, dim: int):
        self.n, self.mean, self.m2 = 0, np.zeros(dim), np.zeros(dim)

    def update(self, x: np.ndarray) -> None:
        self.n += 1
        d = x - self.mean
        self.mean = self.mean + d / self.n
        self.m2 = self.m2 + d * (x - self.mean)

    def merge(self, other: OnlineMahalanobis) -> None:
        n = self.n + other.n
        if n:
            d = other.mean - self.mean
            self.m2 = self.m2 + other.m2 + d * d * self.n * other.n / n
            self.mean, self.n = self.mean + d * other.n / n, n

    @property
    def variance(self) -> np.ndarray:
        return self.m2 / max(self.n - 1, 1)

    def distance(self, x: np.ndarray, floor: float = 1e-12) -> float:
        return float(np.sqrt((((x - self.mean) ** 2) / np.maximum(self.variance, floor)).sum()))
