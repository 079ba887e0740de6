"""Laplacian spectra of graphs of bounded size, connectivities and smoothing of signals on graphs of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved
from .graph import roots
from .neighbours import symmetric

#: Nodes that one group's dense eigenproblem may have.
DENSE = 4000


def _laplacian(g: pd.DataFrame, normalised: bool) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.r_[g["src"], g["dst"]], return_inverse=True)
    n = len(ids)
    if n > DENSE:
        raise ValueError(f"a group has more than {DENSE} nodes")
    w = np.zeros((n, n))
    np.add.at(w, (at[: len(g)], at[len(g) :]), g["w"])
    w = w + w.T
    d = w.sum(1)
    lap = np.diag(d) - w
    if normalised:
        s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0)
        lap = s[:, None] * lap * s
    return ids, lap


def bottom_eigenpairs(edges: DataFrame, k: int, normalised: bool = False) -> DataFrame:
    """(group, index, value, id, entry) of edges (group, src, dst, w): the k least pairs; the largest entry of each is positive."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids, lap = _laplacian(g, normalised)
        w, v = np.linalg.eigh(lap)
        m = min(k, len(w))
        v = v[:, :m] * np.sign(v[np.abs(v[:, :m]).argmax(0), np.arange(m)])
        return pd.DataFrame({"group": g["group"].iloc[0], "index": np.repeat(np.arange(m), len(ids)), "value": np.repeat(w[:m], len(ids)), "id": np.tile(ids, m), "entry": v.T.ravel()})

    return edges.groupBy("group").applyInPandas(one, "group long, index int, value double, id long, entry double")


def _second_value(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, steps: int = 200, tolerance: float = 1e-12) -> float:
    """The second least eigenvalue of a sparse Laplacian: Lanczos steps on its inverse beside the constant, each solved by conjugate gradients."""
    live = w > 0
    a, b, w = a[live], b[live], w[live]
    if roots(n, a, b).any():
        return 0.0  # more than one component
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)

    def lap(x: np.ndarray) -> np.ndarray:
        return degree * x - np.bincount(a, w * x[b], n) - np.bincount(b, w * x[a], n)

    def solve(y: np.ndarray) -> np.ndarray:
        x, r = np.zeros(n), y.copy()
        z = r / degree
        p, rz, goal = z, r @ z, 1e-13 * np.linalg.norm(y)
        for _ in range(20 * n):
            q = lap(p)
            step = rz / (p @ q)
            x, r = x + step * p, r - step * q
            if np.linalg.norm(r) <= goal:
                break
            z = r / degree
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x - x.mean()

    q = np.random.default_rng(0).standard_normal(n)
    q -= q.mean()
    basis, off, diag, best = [q / np.linalg.norm(q)], [], [], np.inf
    for _ in range(min(steps, n - 1)):
        y = solve(basis[-1])
        diag.append(float(y @ basis[-1]))
        q = np.stack(basis)
        for _ in range(2):
            y = y - q.T @ (q @ y)
        ritz, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
        size = float(np.linalg.norm(y))
        # what the Ritz pair leaves over bounds its error
        best, done = 1 / ritz[-1], size * abs(v[-1, -1]) <= tolerance * ritz[-1]
        if done or size <= 1e-14 * ritz[-1]:
            break
        off.append(size)
        basis.append(y / size)
    return float(best)


def algebraic_connectivity(edges: DataFrame) -> DataFrame:
    """(group, connectivity): the second least eigenvalue; a group of more than ``DENSE`` nodes is worked on as a sparse matrix."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.r_[g["src"], g["dst"]], return_inverse=True)
        if len(ids) > DENSE:
            value = [_second_value(at[: len(g)], at[len(g) :], g["w"].to_numpy(float), len(ids))]
        else:
            value = np.linalg.eigvalsh(_laplacian(g, False)[1])[1:2]
        return pd.DataFrame({"group": g["group"].iloc[: len(value)], "connectivity": value})

    return edges.groupBy("group").applyInPandas(one, "group long, connectivity double")


def effective_resistance(edges: DataFrame) -> DataFrame:
    """(group, src, dst, resistance) of every edge, from the pseudo-inverse."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids, lap = _laplacian(g, False)
        p = np.linalg.pinv(lap, hermitian=True)
        a, b = np.searchsorted(ids, g["src"]), np.searchsorted(ids, g["dst"])
        return pd.DataFrame({"group": g["group"], "src": g["src"], "dst": g["dst"], "resistance": p[a, a] + p[b, b] - 2 * p[a, b]})

    return edges.groupBy("group").applyInPandas(one, "group long, src long, dst long, resistance double")


def smooth(edges: DataFrame, signal: DataFrame, strength: float, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(id, value): the solution of (I + strength L) x = signal by Jacobi sweeps, each one join and one aggregation."""
    s = saved(symmetric(edges, "w"), "halves")
    degree = s.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    base = saved(signal.join(degree, "id", "left").select("id", F.col("value").alias("b"), F.coalesce("degree", F.lit(0.0)).alias("degree")), "base")
    x = base.select("id", F.col("b").alias("value"))
    for _ in range(rounds):
        pull = s.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("pull"))
        new = saved(base.join(pull, "id", "left").select("id", ((F.col("b") + strength * F.coalesce("pull", F.lit(0.0))) / (1 + strength * F.col("degree"))).alias("value")), "smooth")
        gap = new.join(x.withColumnRenamed("value", "old"), "id").agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        x = new
        if gap < tolerance:
            break
    return x
