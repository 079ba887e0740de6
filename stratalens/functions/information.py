"""Entropies and divergences of distributions held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import total

FLOOR = 1e-12


def normalised(p: Column) -> Column:
    s = total(p)
    return F.transform(p, lambda x: F.when(s > 0, x / s).otherwise(0.0))


def shannon(p: Column) -> Column:
    """Entropy in nats of counts or probabilities."""
    s = total(p)
    return F.when(s > 0, -total(F.transform(p, lambda x: F.when(x > 0, x / s * F.log(x / s)).otherwise(0.0)))).otherwise(0.0)


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence; both floored, so zeros stay finite."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(F.greatest(x, F.lit(FLOOR)) / F.greatest(y, F.lit(FLOOR)))).otherwise(0.0)))


def symmetric_kl(p: Column, q: Column) -> Column:
    return kl(p, q) + kl(q, p)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence: a metric."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), (kl(p, m) + kl(q, m)) / 2))


def earth_mover(p: Column, q: Column) -> Column:
    from .metrics import wasserstein

    return wasserstein(p, q)
