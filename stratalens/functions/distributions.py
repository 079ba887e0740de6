"""Laws with density, lower tail and quantile, as NumPy functions and as Arrow columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


@dataclass(frozen=True)
class Law:
    """A continuous law on [low, high]."""

    low: float = -math.inf
    high: float = math.inf

    def density(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def below(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def quantile(self, p: np.ndarray) -> np.ndarray:
        """By bisection on the lower tail, from a bracket that doubles until it holds p."""
        p = np.atleast_1d(np.asarray(p, float))
        lo = np.full(p.shape, self.low if math.isfinite(self.low) else -1.0)
        hi = np.full(p.shape, self.high if math.isfinite(self.high) else 1.0)
        for _ in range(200):
            short = self.below(hi) < p
            if math.isfinite(self.high) or not short.any():
                break
            hi = np.where(short, hi * 2 + 1, hi)
        for _ in range(200):
            long = self.below(lo) > p
            if math.isfinite(self.low) or not long.any():
                break
            lo = np.where(long, lo * 2 - 1, lo)
        for _ in range(200):
            mid = (lo + hi) / 2
            up = self.below(mid) < p
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        return (lo + hi) / 2

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return self.quantile(rng.random(n))

    def density_column(self, c: Column) -> Column:
        return self._column(self.density, c)

    def below_column(self, c: Column) -> Column:
        return self._column(self.below, c)

    def quantile_column(self, c: Column) -> Column:
        return self._column(self.quantile, c)

    @staticmethod
    def _column(f, c: Column) -> Column:
        @F.pandas_udf(T.DoubleType())
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(f(s.to_numpy(float)))

        return run(c.cast("double"))


@dataclass(frozen=True)
class Normal(Law):
    mean: float = 0.0
    sd: float = 1.0

    def density(self, x):
        return np.exp(-(((x - self.mean) / self.sd) ** 2) / 2) / (self.sd * math.sqrt(2 * math.pi))

    def below(self, x):
        return (1 + _erf((np.asarray(x) - self.mean) / (self.sd * math.sqrt(2)))) / 2


@dataclass(frozen=True)
class Uniform(Law):
    low: float = 0.0
    high: float = 1.0

    def density(self, x):
        return np.where((x >= self.low) & (x <= self.high), 1 / (self.high - self.low), 0.0)

    def below(self, x):
        return np.clip((np.asarray(x) - self.low) / (self.high - self.low), 0, 1)


@dataclass(frozen=True)
class Gamma(Law):
    low: float = 0.0
    shape: float = 1.0
    rate: float = 1.0

    def density(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, np.exp(self.shape * math.log(self.rate) + (self.shape - 1) * np.log(x) - self.rate * x - math.lgamma(self.shape)), 0.0)

    def below(self, x):
        return np.vectorize(lambda v: gamma_lower(self.shape, self.rate * v), otypes=[float])(x)


@dataclass(frozen=True)
class InverseGamma(Law):
    low: float = 0.0
    shape: float = 2.0
    scale: float = 1.0

    def density(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, np.exp(self.shape * math.log(self.scale) - (self.shape + 1) * np.log(x) - self.scale / x - math.lgamma(self.shape)), 0.0)

    def below(self, x):
        return np.vectorize(lambda v: 1 - gamma_lower(self.shape, self.scale / v) if v > 0 else 0.0, otypes=[float])(x)


@dataclass(frozen=True)
class Beta(Law):
    low: float = 0.0
    high: float = 1.0
    a: float = 1.0
    b: float = 1.0

    def density(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((x > 0) & (x < 1), np.exp(math.lgamma(self.a + self.b) - math.lgamma(self.a) - math.lgamma(self.b) + (self.a - 1) * np.log(x) + (self.b - 1) * np.log1p(-x)), 0.0)

    def below(self, x):
        return np.vectorize(lambda v: beta_lower(self.a, self.b, v), otypes=[float])(x)


@dataclass(frozen=True)
class StudentT(Law):
    df: float = 3.0

    def density(self, x):
        return np.exp(math.lgamma((self.df + 1) / 2) - math.lgamma(self.df / 2)) / math.sqrt(self.df * math.pi) * (1 + np.asarray(x) ** 2 / self.df) ** (-(self.df + 1) / 2)

    def below(self, x):
        def one(v: float) -> float:
            tail = beta_lower(self.df / 2, 0.5, self.df / (self.df + v * v)) / 2
            return 1 - tail if v > 0 else tail

        return np.vectorize(one, otypes=[float])(x)


@dataclass(frozen=True)
class HalfCauchy(Law):
    low: float = 0.0
    scale: float = 1.0

    def density(self, x):
        return np.where(np.asarray(x) >= 0, 2 / (math.pi * self.scale * (1 + (np.asarray(x) / self.scale) ** 2)), 0.0)

    def below(self, x):
        return np.where(np.asarray(x) > 0, 2 / math.pi * np.arctan(np.asarray(x) / self.scale), 0.0)


@dataclass(frozen=True)
class Weibull(Law):
    low: float = 0.0
    shape: float = 1.0
    scale: float = 1.0

    def density(self, x):
        z = np.maximum(np.asarray(x, float), 0) / self.scale
        with np.errstate(divide="ignore"):
            return np.where(np.asarray(x) > 0, self.shape / self.scale * z ** (self.shape - 1) * np.exp(-(z**self.shape)), 0.0)

    def below(self, x):
        return -np.expm1(-((np.maximum(np.asarray(x, float), 0) / self.scale) ** self.shape))


@dataclass(frozen=True)
class AsymmetricLaplace(Law):
    """Density skewed at ``tau``: the mode is its tau-quantile."""

    mode: float = 0.0
    scale: float = 1.0
    tau: float = 0.5

    def density(self, x):
        u = (np.asarray(x) - self.mode) / self.scale
        return self.tau * (1 - self.tau) / self.scale * np.exp(-u * (self.tau - (u < 0)))

    def below(self, x):
        u = (np.asarray(x) - self.mode) / self.scale
        return np.where(u < 0, self.tau * np.exp(np.minimum(u, 0) * (1 - self.tau)), 1 - (1 - self.tau) * np.exp(-np.maximum(u, 0) * self.tau))


@dataclass(frozen=True)
class Truncated(Law):
    """A law conditioned on [low, high]."""

    of: Law = Normal()

    def density(self, x):
        a, b = self.of.below(np.array([self.low, self.high]))
        return np.where((x >= self.low) & (x <= self.high), self.of.density(x) / (b - a), 0.0)

    def below(self, x):
        a, b = self.of.below(np.array([self.low, self.high]))
        return (self.of.below(np.clip(x, self.low, self.high)) - a) / (b - a)


@dataclass(frozen=True)
class Mixture(Law):
    laws: tuple[Law, ...] = ()
    weights: tuple[float, ...] = ()

    def density(self, x):
        return sum(w * f.density(x) for w, f in zip(self.weights, self.laws, strict=True)) / sum(self.weights)

    def below(self, x):
        return sum(w * f.below(x) for w, f in zip(self.weights, self.laws, strict=True)) / sum(self.weights)


def poisson_binomial(p: np.ndarray) -> np.ndarray:
    """Probabilities of 0..n successes of independent trials, one trial at a time."""
    out = np.array([1.0])
    for q in p:
        out = np.r_[out, 0.0] * (1 - q) + np.r_[0.0, out] * q
    return out
