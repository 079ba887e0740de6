"""Distances and kernels, as column builders over arrays of doubles and as NumPy functions.

``METRICS[name](a, b)`` builds a Column; ``numpy_metric(name)(x, y)`` gives all distances
between the rows of two matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def _clip(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(p: float) -> Callable[[Column, Column], Column]:
    p = max(1.0, p)
    return lambda a, b: F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def canberra(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))


def hamming(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0)))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, _clip(dot(a, b) / n)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def angular(a: Column, b: Column) -> Column:
    """Angle over pi."""
    return F.acos(cosine_similarity(a, b)) / F.lit(np.pi)


def spherical(a: Column, b: Column) -> Column:
    """Angle of unit vectors."""
    return F.acos(_clip(dot(a, b)))


def poincare(a: Column, b: Column) -> Column:
    """Distance in the unit ball, points pulled just inside it."""
    top = 1 - 1e-9
    gap = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    room = (1 - F.least(F.lit(top), dot(a, a))) * (1 - F.least(F.lit(top), dot(b, b)))
    return F.acosh(1 + 2 * gap / room)


def lorentz(a: Column, b: Column) -> Column:
    """Hyperboloid distance; the first coordinate is time."""
    inner = dot(a, b) - 2 * F.element_at(a, 1) * F.element_at(b, 1)
    return F.acosh(F.greatest(F.lit(1.0), -inner))


def fisher_rao_simplex(a: Column, b: Column) -> Column:
    return 2 * F.acos(_clip(total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))))


def fisher_rao_normal(a: Column, b: Column) -> Column:
    """Between normals given as (mean, deviation)."""
    m, s = F.element_at(a, 1) - F.element_at(b, 1), F.element_at(a, 2) - F.element_at(b, 2)
    return F.sqrt(F.lit(2.0)) * F.acosh(1 + (m * m / 2 + s * s) / (2 * F.element_at(a, 2) * F.element_at(b, 2)))


def wasserstein(a: Column, b: Column) -> Column:
    """One-dimensional transport between distributions over the same unit-spaced bins."""
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    return F.aggregate(gaps, F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, v: F.struct((s["run"] + v).alias("run"), (s["sum"] + F.abs(s["run"] + v)).alias("sum")), lambda s: s["sum"])


def jaccard_above(threshold: float = 0.0) -> Callable[[Column, Column], Column]:
    """Jaccard distance of the coordinates above a threshold."""

    def build(a: Column, b: Column) -> Column:
        both = total(F.zip_with(a, b, lambda x, y: F.when((x > threshold) & (y > threshold), 1.0).otherwise(0.0)))
        either = total(F.zip_with(a, b, lambda x, y: F.when((x > threshold) | (y > threshold), 1.0).otherwise(0.0)))
        return F.when(either == 0, 0.0).otherwise(1 - both / either)

    return build


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean, "manhattan": manhattan, "l1": manhattan, "chebyshev": chebyshev, "canberra": canberra, "hamming": hamming, "cosine": cosine, "angular": angular,
    "spherical": spherical, "poincare": poincare, "lorentz": lorentz, "fisher_rao_simplex": fisher_rao_simplex, "fisher_rao_normal": fisher_rao_normal, "wasserstein": wasserstein, "jaccard": jaccard_above(),
}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """A metric by name; ``minkowski:p=3`` sets an exponent."""
    if name.startswith("minkowski:p="):
        return minkowski(float(name.split("=")[1]))
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[name]


def numpy_metric(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """All distances between the rows of two matrices, differences taken directly (no cancellation)."""

    def rows(f):
        def all_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            step = max(1, (1 << 22) // max(1, y.size))
            return np.vstack([f(x[s : s + step, None, :], y[None]) for s in range(0, len(x), step)]) if len(x) else np.zeros((0, len(y)))

        return all_pairs

    if name.startswith("minkowski:p="):
        p = max(1.0, float(name.split("=")[1]))
        return rows(lambda a, b: (np.abs(a - b) ** p).sum(-1) ** (1 / p))
    if name == "cosine":
        def cos(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
            return 1 - np.clip(np.divide(x @ y.T, n, out=np.zeros_like(n), where=n > 0), -1, 1)

        return cos
    f = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
        "manhattan": lambda a, b: np.abs(a - b).sum(-1),
        "l1": lambda a, b: np.abs(a - b).sum(-1),
        "chebyshev": lambda a, b: np.abs(a - b).max(-1),
        "hamming": lambda a, b: (a != b).sum(-1).astype(float),
        "poincare": lambda a, b: np.arccosh(1 + 2 * ((a - b) ** 2).sum(-1) / ((1 - np.minimum(1 - 1e-9, (a * a).sum(-1))) * (1 - np.minimum(1 - 1e-9, (b * b).sum(-1))))),
    }
    if name not in f:
        raise ValueError(f"no all-pairs form of {name!r}")
    return rows(f[name])


@dataclass(frozen=True)
class Properties:
    """What may be relied on: the triangle inequality, equal vectors alone at 0, the same distance after a common shift or scaling, and the largest value."""

    triangle: bool = True
    separates: bool = True
    shift_free: bool = False
    scale_free: bool = False
    most: float = float("inf")


_FLAT = Properties(shift_free=True)
PROPERTIES: dict[str, Properties] = {
    "euclidean": _FLAT, "manhattan": _FLAT, "l1": _FLAT, "chebyshev": _FLAT, "canberra": Properties(), "hamming": _FLAT,
    "cosine": Properties(triangle=False, separates=False, scale_free=True, most=2.0), "angular": Properties(separates=False, scale_free=True), "spherical": Properties(separates=False, scale_free=True),
    "poincare": Properties(), "lorentz": Properties(), "fisher_rao_simplex": Properties(), "fisher_rao_normal": Properties(), "wasserstein": Properties(), "jaccard": Properties(separates=False, most=1.0),
}


def properties(name: str) -> Properties:
    """Of a metric by name; a Minkowski exponent below 1 has no triangle inequality."""
    if name.startswith("minkowski:p="):
        return Properties(triangle=float(name.split("=")[1]) >= 1, shift_free=True)
    if name not in PROPERTIES:
        raise ValueError(f"unknown metric {name!r}")
    return PROPERTIES[name]


@dataclass(frozen=True)
class Kernel:
    """How a coupling falls: its logarithm, its slope's bound at bandwidth 1, whether it ends, and whether it is positive definite in every dimension."""

    log: Callable[[Column, Column], Column]
    slope: float
    compact: bool = False
    positive_definite: bool = True


KERNEL_FACTS: dict[str, Kernel] = {
    "gaussian": Kernel(lambda d, h: -d * d / (2 * h * h), math.exp(-0.5)),
    "laplacian": Kernel(lambda d, h: -d / h, 1.0),
    "cauchy": Kernel(lambda d, h: -F.log1p((d / h) * (d / h)), 3 * math.sqrt(3) / 8),
    "linear": Kernel(lambda d, h: F.log(F.greatest(F.lit(0.0), 1 - d / h)), 1.0, compact=True, positive_definite=False),
}

#: Kernels of a distance column at a bandwidth.
KERNELS: dict[str, Callable[[Column, Column], Column]] = {
    "gaussian": lambda d, h: F.exp(-d * d / (2 * h * h)),
    "laplacian": lambda d, h: F.exp(-d / h),
    "cauchy": lambda d, h: 1 / (1 + (d / h) * (d / h)),
    "linear": lambda d, h: F.greatest(F.lit(0.0), 1 - d / h),
}


def mixture(d: Column, bandwidths: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of kernels."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * KERNELS[name](d, bandwidths[name])
    return out / F.lit(float(sum(weights.values())))
