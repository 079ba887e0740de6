"""Mini-batch k-means on exponentially decayed counts and sums, over a table of points.

An epoch deals the points to batches by a hash of (id, epoch) and saves them in order of
their batch, so that an update reads its batch alone. What the driver holds is centroids
and counts (k by dimension); each update is one aggregation of k rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved
from .cluster import _sums, assign

# The published power laws of batch size and peak step, and the grid they were fitted on.
BATCH_LAW = (0.035, 0.13, 0.88, 0.81)  # of k, n and epochs
STEP_LAW = (0.824, -0.46, 0.90, -0.45, -0.11)  # of k, batch, n and epochs
UNDIVIDED = 2_000_000
GRID = {"n": (1e5, 1e7), "k": 256, "points a cluster": 8, "batch": 256, "epochs": 25}


def batch_size(n: int, k: int, epochs: int) -> int:
    """The law's size as the nearest power of two, at most n; an eighth of it for more than two million points."""
    c, a, b, e = BATCH_LAW
    size = c * k**a * n**b * epochs**e / (8 if n > UNDIVIDED else 1)
    return max(1, min(n, 2 ** round(math.log2(max(size, 1)))))


def peak_step(n: int, k: int, epochs: int, batch: int) -> float:
    c, a, b, d, e = STEP_LAW
    return min(1.0, c * k**a * batch**b * n**d * epochs**e)


def extrapolations(n: int, k: int, epochs: int, batch: int) -> list[str]:
    """The bounds of the laws' grid that a problem crosses."""
    out = [name for name, x, lo in (("n", n, GRID["n"][0]), ("k", k, GRID["k"]), ("points a cluster", n / k, GRID["points a cluster"]), ("batch", batch, GRID["batch"])) if x < lo]
    return out + [name for name, x, hi in (("n", n, GRID["n"][1]), ("batch", batch, n / 4), ("epochs", epochs, GRID["epochs"])) if x > hi]


def step_at(t: int, updates: int, peak: float, floor: float = 0.1, cosine: bool = True) -> float:
    """The step of update t: from the peak along half a cosine towards ``floor`` of it."""
    return peak * (floor + (1 - floor) * 0.5 * (1 + math.cos(math.pi * t / updates))) if cosine else peak


@dataclass(frozen=True)
class Settings:
    """``final``: "last_epoch" (means of the last epoch's assignments), "fast" or "slow" (decayed means). A batch or peak of None follows the laws."""

    k: int
    epochs: int
    seed: int = 42
    batch: int | None = None
    peak: float | None = None
    floor: float = 0.1
    cosine: bool = True
    start_count: float = 1e-10
    revive_every: int = 5
    dead_below: float = 0.1
    split: float = 1 / 1024
    slow: float = 1.0
    final: str = "last_epoch"


@dataclass
class Fit:
    centroids: np.ndarray
    counts: np.ndarray
    labels: DataFrame
    distortion: float
    batch: int
    peak: float
    trace: list[tuple[int, float, int]]
    outside: list[str]


def _batch_sums(batch: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and squared distances by centre: added up by centre before they come to the driver."""
    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": g["label"].iloc[:1], "n": [int(g["n"].sum())], "s": [np.sum(np.stack(g["s"]), 0).tolist()], "q": [float(g["q"].sum())]})

    kind = "label int, n long, s array<double>, q double"
    rows = batch.select("id", "features").mapInPandas(_sums(centres), kind).where("n > 0").groupBy("label").applyInPandas(added, kind).collect()
    n, s, q = np.zeros(len(centres)), np.zeros_like(centres), np.zeros(len(centres))
    for r in rows:
        n[r["label"]], s[r["label"]], q[r["label"]] = r["n"], r["s"], r["q"]
    return n, s, q


def cluster(points: DataFrame, settings: Settings, start: np.ndarray | None = None) -> Fit:
    """A run over (id, features): the same data, settings and start give the same centroids, however points are partitioned, up to the order of additions."""
    c = settings
    total = points.count()
    if not 1 <= c.k <= total:
        raise ValueError("k must lie between 1 and the number of points")
    rng = np.random.default_rng(c.seed)
    if start is None:
        first = points.orderBy(F.xxhash64(F.lit(c.seed), "id"), "id").limit(c.k).collect()
        start = np.array([r["features"] for r in first], float)
    size = c.batch or batch_size(total, c.k, c.epochs)
    peak = c.peak or peak_step(total, c.k, c.epochs, size)
    batches = -(-total // size)
    updates, t = c.epochs * batches, 0
    centres = np.array(start, float)
    n, s, q = np.full(c.k, c.start_count), centres * c.start_count, np.zeros(c.k)
    slow_n, slow_s = n.copy(), s.copy()
    trace: list[tuple[int, float, int]] = []
    for epoch in range(c.epochs):
        dealt = points.select("id", "features", F.pmod(F.xxhash64(F.lit(c.seed), F.lit(epoch), "id"), F.lit(batches)).alias("batch"))
        dealt = saved(dealt.repartitionByRange("batch", "id").sortWithinPartitions("batch"), "epoch")
        seen_n, seen_s, cost, revived = np.zeros(c.k), np.zeros_like(centres), 0.0, 0
        for b in range(batches):
            bn, bs, bq = _batch_sums(dealt.where(F.col("batch") == b), centres)
            a = step_at(t, updates, peak, c.floor, c.cosine)
            n, s, q = (1 - a) * n + a * bn, (1 - a) * s + a * bs, (1 - a) * q + a * bq
            w = min(1.0, c.slow * c.floor * peak)
            slow_n, slow_s = (1 - w) * slow_n + w * bn, (1 - w) * slow_s + w * bs
            held = n > c.start_count * 1e-3
            centres = np.where(held[:, None], s / np.maximum(n, 1e-300)[:, None], centres)
            seen_n, seen_s, cost, t = seen_n + bn, seen_s + bs, cost + bq.sum(), t + 1
            if c.revive_every and t % c.revive_every == 0:
                for dead in np.flatnonzero(n < c.dead_below * n.mean()):
                    donor = int(n.argmax())
                    turn = rng.standard_normal(centres.shape[1])
                    turn *= c.split * math.sqrt(max(q[donor], 0) / max(n[donor], 1e-300)) / np.linalg.norm(turn)
                    middle = centres[donor].copy()
                    for k, at in ((donor, middle + turn), (dead, middle - turn)):
                        n[k] = n[donor] / 2 if k == donor else n[donor]
                        centres[k], s[k], q[k] = at, at * n[k], q[donor] / 2 if k == donor else q[donor]
                        slow_n[k], slow_s[k] = n[k], at * n[k]
                        seen_n[k], seen_s[k] = 0, 0  # what the last epoch saw of either is no longer theirs
                    revived += 1
        trace.append((epoch, cost / total, revived))
    if c.final == "last_epoch":
        centres = np.where((seen_n > 0)[:, None], seen_s / np.maximum(seen_n, 1)[:, None], centres)
    elif c.final == "slow":
        centres = slow_s / np.maximum(slow_n, 1e-300)[:, None]
    labels = assign(points, centres)
    return Fit(centres, n, labels, float(labels.agg(F.avg("sq")).first()[0]), size, peak, trace, extrapolations(total, c.k, c.epochs, size))
