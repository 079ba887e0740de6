"""Means and medians on manifolds, robust components, and distances between barcodes.

Location estimates iterate on the driver over one point; each round is one pass of partial
sums, a row a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved


@dataclass(frozen=True)
class Manifold:
    """log(p, x): tangent vectors at p to the rows of x; exp(p, v): the point they lead to; norm(p, v)."""

    log: Callable[[np.ndarray, np.ndarray], np.ndarray]
    exp: Callable[[np.ndarray, np.ndarray], np.ndarray]
    norm: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sphere_log(p, x):
    c = np.clip(x @ p, -1, 1)
    v = x - c[:, None] * p
    n = np.linalg.norm(v, axis=1)
    return np.divide(np.arccos(c), n, out=np.zeros_like(n), where=n > 1e-15)[:, None] * v


def _sphere_exp(p, v):
    n = np.linalg.norm(v)
    return p if n < 1e-15 else math.cos(n) * p + math.sin(n) * v / n


def _moebius(p, x):
    d, pp, xx = x @ p, p @ p, (x * x).sum(-1)
    return ((1 + 2 * d + xx)[..., None] * p + (1 - pp) * x) / (1 + 2 * d + pp * xx)[..., None]


def _ball_log(p, x):
    u = _moebius(-p, x)
    n = np.linalg.norm(u, axis=1)
    return (1 - p @ p) * np.divide(np.arctanh(np.minimum(n, 1 - 1e-15)), n, out=np.zeros_like(n), where=n > 1e-15)[:, None] * u


def _ball_exp(p, v):
    n = np.linalg.norm(v)
    return p if n < 1e-15 else _moebius(p, (math.tanh(n / (1 - p @ p)) / n * v)[None])[0]


MANIFOLDS = {
    "euclidean": Manifold(lambda p, x: x - p, lambda p, v: p + v, lambda p, v: np.linalg.norm(v, axis=-1)),
    "sphere": Manifold(_sphere_log, _sphere_exp, lambda p, v: np.linalg.norm(v, axis=-1)),
    "ball": Manifold(_ball_log, _ball_exp, lambda p, v: 2 / (1 - p @ p) * np.linalg.norm(v, axis=-1)),
}


def location(points: DataFrame, manifold: str = "euclidean", median: bool = False, rounds: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(point, scatter): the intrinsic mean, or the median by reweighting; scatter is the mean squared (median: plain) distance."""
    m = MANIFOLDS[manifold]
    points = saved(points.select("features"), "points")
    p = np.array(points.first()["features"], float)

    for _ in range(rounds):

        def sums(parts: Iterator[pd.DataFrame], p=p) -> Iterator[pd.DataFrame]:
            w, v, s, n = 0.0, np.zeros_like(p), 0.0, 0
            for b in parts:
                if len(b):
                    t = m.log(p, np.stack(b["features"].to_numpy()))
                    d = m.norm(p, t)
                    k = np.where(d > 1e-12, 1 / np.maximum(d, 1e-12), 0) if median else np.ones(len(d))
                    w, v, s, n = w + k.sum(), v + k @ t, s + (d if median else d * d).sum(), n + len(d)
            yield pd.DataFrame({"w": [w], "v": [v.tolist()], "s": [s], "n": [n]})

        rows = points.mapInPandas(sums, "w double, v array<double>, s double, n long").collect()  # a row a task
        w, v = sum(r["w"] for r in rows), sum(np.array(r["v"]) for r in rows)
        scatter = sum(r["s"] for r in rows) / sum(r["n"] for r in rows)
        if not w:
            break
        step = v / w
        p = m.exp(p, step)
        if np.linalg.norm(step) < tolerance:
            break
    return p, float(scatter)


def block_components(points: DataFrame, k: int, blocks: int = 9) -> np.ndarray:
    """The leading components of the entrywise median of the blocks' covariances: outliers spoil few blocks."""
    b = points.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), "features")
    x = b.select("b", F.posexplode("features").alias("i", "x"), "features").select("b", "i", "x", F.posexplode("features").alias("j", "y"))
    c = x.groupBy("b", "i", "j").agg((F.avg(F.col("x") * F.col("y")) - F.avg("x") * F.avg("y")).alias("c")).groupBy("i", "j").agg(F.percentile("c", 0.5).alias("c")).collect()  # dimension^2 rows
    n = max(r["i"] for r in c) + 1
    m = np.zeros((n, n))
    for r in c:
        m[r["i"], r["j"]] = r["c"]
    v = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :k].T
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


# Distances between barcodes

def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost matching of all rows (no more than columns): shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of, out = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        least, way, open_ = np.full(m, np.inf), np.zeros(m, int), np.ones(m, bool)
        i, low, done = start, 0.0, []
        while True:
            reach = cost[i] - v
            reach += low - u[i]
            better = np.flatnonzero((reach < least) & open_)
            least[better], way[better] = reach[better], i
            ahead = np.where(open_, least, np.inf)
            j = int(ahead.argmin())
            low = ahead[j]
            if row_of[j] >= 0:
                free = np.flatnonzero((ahead == low) & (row_of < 0))
                j = int(free[0]) if len(free) else j
            if row_of[j] < 0:
                break
            open_[j] = False
            done.append(j)
            i = int(row_of[j])
        d = np.array(done, int)
        u[start] += low
        u[row_of[d]] += low - least[d]
        v[d] -= low - least[d]
        while True:
            i = int(way[j])
            row_of[j], out[i], j = i, j, out[i]
            if i == start:
                break
    return out


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest coordinate difference; to the diagonal, half the length; diagonal to diagonal, nothing."""
    n, m = len(a), len(b)
    c = np.zeros((n + m, n + m))
    if n and m:
        c[:n, :m] = np.abs(a[:, None] - b[None]).max(-1)
    c[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None] if n else 0
    c[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None] if m else 0
    return c


def _on_a_line(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, p: float) -> float:
    """Least cost of bars born together, from deaths and costs to the diagonal: pairs that cross gain nothing, so one pass over the sorted deaths finds it."""
    i, j = np.argsort(a), np.argsort(b)
    a, b, x, y = a[i], b[j], x[i], y[j]
    skipped = np.r_[0.0, np.cumsum(y)]
    best = skipped.copy()
    for t, c in zip(a, x, strict=True):
        new = best + c
        new[1:] = np.minimum(new[1:], best[:-1] + np.abs(b - t) ** p)
        best = np.minimum.accumulate(new - skipped) + skipped
    return float(best[-1])


def wasserstein(a: np.ndarray, b: np.ndarray, p: float = 1.0) -> float:
    """Exact distance of finite bars (birth, death).

    Bars of length zero cost nothing and help no other. A pair of bars costs no more than
    both to the diagonal, so each of the fewer bars may be given one of the more.
    """
    a, b = (x.reshape(-1, 2)[x.reshape(-1, 2)[:, 1] > x.reshape(-1, 2)[:, 0]] for x in (a, b))
    if len(a) > len(b):
        a, b = b, a
    x, y = (((z[:, 1] - z[:, 0]) / 2) ** p for z in (a, b))
    if not len(a):
        return float(y.sum() ** (1 / p))
    if p >= 1 and (a[:, 0] == a[0, 0]).all() and (b[:, 0] == a[0, 0]).all():
        return _on_a_line(a[:, 1], b[:, 1], x, y, p) ** (1 / p)
    c = np.empty((len(a), len(b)))
    for r in range(len(a)):
        c[r] = np.minimum(np.maximum(np.abs(a[r, 0] - b[:, 0]), np.abs(a[r, 1] - b[:, 1])) ** p, x[r] + y) - y
    return float((c[np.arange(len(a)), assignment(c)].sum() + y.sum()) ** (1 / p))


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """Least largest cost of a matching, by bisection over the costs."""
    c = _costs(a, b)
    if not len(c):
        return 0.0
    levels = np.unique(c)
    lo, hi = 0, len(levels) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        far = (c > levels[mid]).astype(float)
        lo, hi = (lo, mid) if far[np.arange(len(c)), assignment(far)].sum() == 0 else (mid + 1, hi)
    return float(levels[lo])


def essential_distance(a: np.ndarray, b: np.ndarray, p: float = 1.0) -> float:
    """Of births of bars that never die: sorted births are matched; different numbers are infinitely far apart."""
    if len(a) != len(b):
        return math.inf
    return float((np.abs(np.sort(a) - np.sort(b)) ** p).sum() ** (1 / p)) if len(a) else 0.0


def sliced(a: np.ndarray, b: np.ndarray, directions: int = 50) -> float:
    """Sliced distance: each side is completed by the other's projections to the diagonal."""
    flat = lambda x: np.repeat(x.mean(1, keepdims=True), 2, 1) if len(x) else x.reshape(0, 2)
    u, v = np.vstack([a.reshape(-1, 2), flat(b)]), np.vstack([b.reshape(-1, 2), flat(a)])
    t = np.linspace(-math.pi / 2, math.pi / 2, directions, endpoint=False)
    d = np.stack([np.cos(t), np.sin(t)])
    return float(np.abs(np.sort(u @ d, 0) - np.sort(v @ d, 0)).sum(0).mean())


def diagram_distances(bars: DataFrame, kind: str = "wasserstein", max_bars: int = 500) -> DataFrame:
    """(first, second, dim, distance) of every two groups of bars (group, dim, birth, death), by dimension.

    Diagrams, not bars, are paired, and a pair is one task's work: Wasserstein distances hold
    a number for each two bars of positive length, unless all are born together; bottleneck
    distances are refused beyond ``max_bars`` bars a side.
    """
    f = {"wasserstein": wasserstein, "bottleneck": bottleneck, "sliced": sliced}[kind]
    d = bars.groupBy("group", "dim").agg(F.collect_list(F.when(F.col("death") < float("inf"), F.struct("birth", "death"))).alias("bars"), F.collect_list(F.when(F.col("death") == float("inf"), F.col("birth"))).alias("ever"))
    x, y = (d.select(F.col("group").alias(g), "dim", F.col("bars").alias(f"b{k}"), F.col("ever").alias(f"e{k}")) for g, k in (("first", 1), ("second", 2)))
    j = x.join(y, "dim").where("first < second")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                a, b = (np.array([(z["birth"], z["death"]) for z in w], float).reshape(-1, 2) for w in (r.b1, r.b2))
                if kind == "bottleneck" and max(len(a), len(b)) > max_bars:
                    raise ValueError(f"a diagram has more than {max_bars} bars")
                out.append(f(a, b) + essential_distance(np.array(r.e1, float), np.array(r.e2, float)))
            yield pd.DataFrame({"first": p["first"], "second": p["second"], "dim": p["dim"], "distance": out})

    j = j.repartition(max(1, d.sparkSession.sparkContext.defaultParallelism) * 4, "first", "second", "dim")
    return j.mapInPandas(run, "first long, second long, dim int, distance double")
