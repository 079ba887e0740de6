"""Components of a Gaussian mixture merged into clusters, by their modes or by the entropy of memberships; constrained memberships."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bhattacharyya, log_density
from .graph import roots


def _chol(model: dict) -> list[np.ndarray]:
    dim = model["means"].shape[1]
    return [np.linalg.cholesky(c + model["ridge"] * np.eye(dim)) for c in model["covariances"]]


def ascend(model: dict, x: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """The modes of the mixture's density above each row: the fixed point of precisions and their pulls, weighted by memberships."""
    chol = _chol(model)
    precision = [np.linalg.inv(l @ l.T) for l in chol]
    pull = [p @ m for p, m in zip(precision, model["means"], strict=True)]
    x = np.array(x, float)
    for _ in range(rounds):
        lp = log_density(x, model["weights"], model["means"], chol)
        r = np.exp(lp - lp.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        a = np.einsum("nk,kij->nij", r, np.array(precision))
        new = np.linalg.solve(a, (r @ np.array(pull))[..., None])[..., 0]
        done = np.abs(new - x).max() < tolerance
        x = new
        if done:
            break
    return x


def merge_by_mode(model: dict, distance: float = 1e-3) -> np.ndarray:
    """A cluster for each component: those whose means climb to one mode, up to ``distance`` in units of the components' spread."""
    modes = ascend(model, model["means"])
    scale = math.sqrt(float(np.mean([np.trace(c) for c in model["covariances"]])) / modes.shape[1]) or 1.0
    near = ((modes[:, None] - modes[None]) ** 2).sum(2) <= (distance * scale) ** 2
    a, b = np.nonzero(np.triu(near, 1))
    return np.unique(roots(len(modes), a, b), return_inverse=True)[1]


def merge_by_overlap(model: dict, threshold: float = 0.5) -> np.ndarray:
    """A cluster for each component: those that chains of overlap coefficients of at least ``threshold`` connect."""
    k = len(model["weights"])
    c = [x + model["ridge"] * np.eye(x.shape[0]) for x in model["covariances"]]
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k) if bhattacharyya(model["means"][i], c[i], model["means"][j], c[j]) >= threshold]
    a, b = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
    return np.unique(roots(k, a, b), return_inverse=True)[1]


def entropy_gains(memberships: DataFrame, groups: np.ndarray) -> np.ndarray:
    """How much each pair of groups would lower the memberships' entropy by merging; one pass, a matrix a task."""
    n = int(groups.max()) + 1
    fold = np.eye(n)[groups]

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        h = lambda p: p * np.log(np.maximum(p, 1e-300))
        for part in parts:
            for s in range(0, len(part), 4096):
                p = np.stack(part["p"].iloc[s : s + 4096].to_numpy()) @ fold
                total += (h(p[:, :, None] + p[:, None]) - h(p)[:, :, None] - h(p)[:, None]).sum(0)
        yield pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": total.ravel()})

    rows = memberships.select("p").mapInPandas(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # n by n
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    np.fill_diagonal(out, -np.inf)
    return out


def merge_by_entropy(memberships: DataFrame, components: int, clusters: int) -> tuple[np.ndarray, list[float]]:
    """(cluster of each component, entropy lowered by each merge): the pair that lowers it most is merged until ``clusters`` are left."""
    groups, gains = np.arange(components), []
    while groups.max() + 1 > clusters:
        g = entropy_gains(memberships, groups)
        i, j = sorted(map(int, np.unravel_index(int(g.argmax()), g.shape)))
        gains.append(float(g[i, j]))
        groups = np.unique(np.where(groups == j, i, groups), return_inverse=True)[1]
    return groups, gains


def merged(memberships: DataFrame, groups: np.ndarray) -> DataFrame:
    """(id, label, p): memberships added up within each cluster."""
    size = int(groups.max()) + 1
    p = F.array(*[sum((F.col("p")[int(k)] for k in np.flatnonzero(groups == g)), F.lit(0.0)) for g in range(size)])
    return memberships.select("id", p.alias("p")).select("id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), "p")


#: Ways to merge components, from a model and the table of memberships, to a cluster for each component.
STRATEGIES: dict[str, Callable] = {"modes": lambda model, rows, k: merge_by_mode(model), "overlap": lambda model, rows, k: merge_by_overlap(model), "entropy": lambda model, rows, k: merge_by_entropy(rows, len(model["weights"]), k)[0]}


def annealed(memberships: DataFrame, known: DataFrame, strength: float) -> DataFrame:
    """(id, label, p): memberships bent towards known labels (id, label) by a factor exp(strength) on their component; 0 leaves them, a large one fixes them."""
    j = memberships.select("id", "p").join(known.select("id", F.col("label").alias("_known")), "id", "left")
    bent = F.transform("p", lambda x, k: F.when(F.col("_known") == k, x * math.exp(min(strength, 700.0))).otherwise(x))
    b = j.select("id", bent.alias("b")).withColumn("s", F.aggregate("b", F.lit(0.0), lambda a, x: a + x))
    p = b.select("id", F.transform("b", lambda x: x / F.col("s")).alias("p"))
    return p.select("id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), "p")
