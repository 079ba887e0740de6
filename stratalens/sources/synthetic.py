"""Labelled point clouds as column expressions over ``spark.range``.

Random numbers are hashes of (row, seed, place): a row's point does not depend on how
rows are dealt to tasks, and any number of rows is generated where it is used. Every
generator returns (id, features array<double>, label int, level_labels array<int>).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, place: int, row: Column | None = None) -> Column:
    """In (0, 1), by row (the id unless given)."""
    h = F.xxhash64(F.col("id") if row is None else row, F.lit(seed), F.lit(place))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, place: int, row: Column | None = None) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, 2 * place, row))) * F.cos(2 * math.pi * uniform(seed, 2 * place + 1, row))


def exponential(seed: int, place: int) -> Column:
    return -F.log(uniform(seed, place))


def _cloud(spark: SparkSession, n: int, label: Column, coordinates: list[Column], levels: list[Column] | None = None) -> DataFrame:
    return spark.range(n).select("id", F.array(*coordinates).alias("features"), label.cast("int").alias("label"), F.array(*[x.cast("int") for x in levels or [label]]).alias("level_labels"))


def _centre(seed: int, k: Column, axis: int, radius: float) -> Column:
    """A centre's coordinate, the same for all rows of a cluster."""
    return radius * normal(seed + 7919, axis, k)


def spatial_blobs(spark: SparkSession, clusters: int = 4, points: int = 1500, dimensions: int = 2, spread: float = 1.0, radius: float = 8.0, seed: int = 42) -> DataFrame:
    k = F.col("id") % clusters
    return _cloud(spark, clusters * points, k, [_centre(seed, k, a, radius) + spread * normal(seed, a) for a in range(dimensions)])


def anisotropic_gaussians(spark: SparkSession, clusters: int = 3, points: int = 2000, stretch: float = 4.0, radius: float = 10.0, seed: int = 42) -> DataFrame:
    """Rotated ellipses around a circle of centres."""
    k = F.col("id") % clusters
    turn, at = math.pi * uniform(seed + 1, 0, k), 2 * math.pi * k / clusters
    x, y = stretch * normal(seed, 0), normal(seed, 1)
    return _cloud(spark, clusters * points, k, [radius * F.cos(at) + x * F.cos(turn) - y * F.sin(turn), radius * F.sin(at) + x * F.sin(turn) + y * F.cos(turn)])


def two_moons(spark: SparkSession, points: int = 3000, noise: float = 0.05, seed: int = 42) -> DataFrame:
    k, t = F.col("id") % 2, math.pi * uniform(seed, 100)
    return _cloud(spark, 2 * points, k, [F.when(k == 0, F.cos(t)).otherwise(1 - F.cos(t)) + noise * normal(seed, 0), F.when(k == 0, F.sin(t)).otherwise(0.5 - F.sin(t)) + noise * normal(seed, 1)])


def three_level_hierarchy(spark: SparkSession, coarse: int = 2, medium: int = 3, fine: int = 4, points: int = 250, seed: int = 42) -> DataFrame:
    """Nested Gaussians; level_labels from coarse to fine."""
    f = F.col("id") % (coarse * medium * fine)
    m, c = F.floor(f / fine), F.floor(f / (fine * medium))
    xy = [40 * normal(seed + 11, a, c) + 8 * normal(seed + 13, a, m) + 2 * normal(seed + 17, a, f) + 0.3 * normal(seed, a) for a in range(2)]
    return _cloud(spark, coarse * medium * fine * points, f, xy, [c, m, f])


def dense_regions(spark: SparkSession, points: int = 2000, background: float = 0.2, seed: int = 42) -> DataFrame:
    """Three dense discs in a thin uniform background (label 3)."""
    k = F.when(uniform(seed, 100) < background, F.lit(3)).otherwise(F.col("id") % 3)
    centres = ((-4.0, 0.0), (4.0, 0.0), (0.0, 5.0))
    xy = [F.coalesce(*[F.when(k == i, c[a] + normal(seed, a)) for i, c in enumerate(centres)], 20 * uniform(seed, 110 + a) - 10) for a in range(2)]
    return _cloud(spark, 3 * points, k, xy)


def crescent_and_ellipsoid(spark: SparkSession, points: int = 2000, noise: float = 0.15, seed: int = 42) -> DataFrame:
    k, t = F.col("id") % 2, math.pi * (0.1 + 0.8 * uniform(seed, 100))
    crescent = [4 * F.cos(t) + noise * normal(seed, 0), 4 * F.sin(t) + noise * normal(seed, 1), noise * normal(seed, 2)]
    ellipsoid = [1.2 * normal(seed, 3), 0.4 * normal(seed, 4) + 1, 0.4 * normal(seed, 5)]
    return _cloud(spark, 2 * points, k, [F.when(k == 0, a).otherwise(b) for a, b in zip(crescent, ellipsoid, strict=True)])


def mobius_and_ellipsoid(spark: SparkSession, points: int = 2000, half_width: float = 0.6, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """A Moebius band around an ellipsoid, in three dimensions."""
    k, t, s = F.col("id") % 2, 2 * math.pi * uniform(seed, 100), half_width * (2 * uniform(seed, 101) - 1)
    r = 3 + s * F.cos(t / 2)
    band = [r * F.cos(t), r * F.sin(t), s * F.sin(t / 2)]
    return _cloud(spark, 2 * points, k, [F.when(k == 0, b + noise * normal(seed, a)).otherwise(0.5 * normal(seed, 5 + a)) for a, b in enumerate(band)])


def sparse_supports(spark: SparkSession, clusters: int = 4, points: int = 1500, support: int = 5, seed: int = 42) -> DataFrame:
    """Each cluster lives on coordinates of its own."""
    k = F.col("id") % clusters
    return _cloud(spark, clusters * points, k, [F.when(k == F.lit(a // support), 3 + normal(seed, a)).otherwise(F.lit(0.0)) for a in range(clusters * support)])


def simplex_clusters(spark: SparkSession, clusters: int = 5, points: int = 1200, dimensions: int = 5, concentration: int = 6, seed: int = 42) -> DataFrame:
    """Dirichlet clusters on the probability simplex: each leans to one corner; rows sum to 1."""
    k = F.col("id") % clusters
    g = []
    for a in range(dimensions):
        lean = sum((exponential(seed, 1000 + a * concentration + j) for j in range(concentration)), F.lit(0.0))
        g.append(exponential(seed, a) + F.when(k == a % clusters, lean).otherwise(0.0))
    total = sum(g, F.lit(0.0))
    return _cloud(spark, clusters * points, k, [x / total for x in g])


def hyperbolic_blobs(spark: SparkSession, clusters: int = 3, points: int = 2000, spread: float = 0.3, reach: float = 2.0, seed: int = 42) -> DataFrame:
    """Normal steps in the tangent plane at the origin, moved to centres by Moebius addition, in the open unit disc."""
    k = F.col("id") % clusters
    at = 2 * math.pi * k / clusters
    p = math.tanh(reach / 2)
    px, py = p * F.cos(at), p * F.sin(at)
    u, v = spread * normal(seed, 0), spread * normal(seed, 1)
    n = F.sqrt(u * u + v * v)
    scale = F.when(n > 0, F.tanh(n / 2) / n).otherwise(0.5)
    x, y = u * scale, v * scale
    d, pp, xx = px * x + py * y, px * px + py * py, x * x + y * y
    low = 1 + 2 * d + pp * xx
    return _cloud(spark, clusters * points, k, [((1 + 2 * d + xx) * c + (1 - pp) * z) / low for c, z in ((px, x), (py, y))])


def hyperbolic_hierarchy(spark: SparkSession, points: int = 6000, branches: int = 3, depth: int = 3, seed: int = 42) -> DataFrame:
    """A tree in the unit disc: children lie further out within their parent's sector; level_labels by depth."""
    leaf = F.col("id") % (branches**depth)
    angle, levels = F.lit(0.0), []
    for level in range(1, depth + 1):
        node = F.floor(leaf / branches ** (depth - level))
        levels.append(node)
        angle = angle + (node % branches - (branches - 1) / 2) * 2 * math.pi / branches**level
    r = F.tanh((depth * 1.1 + 0.15 * normal(seed, 0)) / 2)
    t = angle + 0.2 * 2 * math.pi / branches**depth * normal(seed, 1)
    return _cloud(spark, points, leaf, [r * F.cos(t), r * F.sin(t)], levels)


def normal_family(spark: SparkSession, clusters: int = 3, points: int = 2000, seed: int = 42) -> DataFrame:
    """(mean, deviation) points of the half-plane of normal laws."""
    k = F.col("id") % clusters
    return _cloud(spark, clusters * points, k, [4 * k + 0.4 * normal(seed, 0), F.exp(0.5 * k - 0.5 + 0.2 * normal(seed, 1))])


def eye_torus(spark: SparkSession, points: int = 6000, seed: int = 42) -> DataFrame:
    """Lids, iris ring and pupil in three dimensions; level_labels (coarse, fine)."""
    part, t, s = F.col("id") % 4, 2 * math.pi * uniform(seed, 100), 2 * math.pi * uniform(seed, 101)
    tube = lambda big, small: [(big + small * F.cos(s)) * F.cos(t), (big + small * F.cos(s)) * F.sin(t), small * F.sin(s)]
    half = math.pi * (0.05 + 0.9 * uniform(seed, 102))
    lid = lambda sign: [6 * F.cos(half) + 0.2 * normal(seed, 0), sign * 2.5 * F.sin(half) + 0.2 * normal(seed, 1), 0.2 * normal(seed, 2)]
    shapes = [lid(1), lid(-1), tube(1.8, 0.3), [0.3 * normal(seed, 3), 0.3 * normal(seed, 4), 0.3 * normal(seed, 5)]]
    xyz = [F.coalesce(*[F.when(part == i, shape[a]) for i, shape in enumerate(shapes)]) for a in range(3)]
    return _cloud(spark, points, part, xyz, [F.when(part < 2, 0).otherwise(part - 1), part])


GENERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (spatial_blobs, anisotropic_gaussians, two_moons, three_level_hierarchy, dense_regions, crescent_and_ellipsoid, mobius_and_ellipsoid, sparse_supports, simplex_clusters, hyperbolic_blobs, hyperbolic_hierarchy, normal_family, eye_torus)
}
