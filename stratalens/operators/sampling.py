"""Weights, resampling, adaptive sequential Monte Carlo, chains, and exact change points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalise(log_weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, log of their mean, effective sample size)."""
    top = log_weights.max()
    w = np.exp(log_weights - top)
    return w / w.sum(), float(top + math.log(w.mean())), float(w.sum() ** 2 / (w * w).sum())


def resample(weights: np.ndarray, scheme: str, rng: np.random.Generator) -> np.ndarray:
    """Indices by the multinomial, stratified, systematic or residual scheme."""
    n = len(weights)
    if scheme == "residual":
        sure = np.floor(n * weights).astype(int)
        rest = n * weights - sure
        out = np.repeat(np.arange(n), sure)
        k = n - len(out)
        return out if not k else np.r_[out, rng.choice(n, k, p=rest / rest.sum())]
    u = {"multinomial": lambda: np.sort(rng.random(n)), "stratified": lambda: (np.arange(n) + rng.random(n)) / n, "systematic": lambda: (np.arange(n) + rng.random()) / n}[scheme]()
    return np.minimum(np.searchsorted(np.cumsum(weights), u), n - 1)


def smc(reference: Callable[[np.random.Generator, int], np.ndarray], log_likelihood: Callable[[np.ndarray], np.ndarray], log_prior: Callable[[np.ndarray], np.ndarray], n: int, seed: int = 0, keep: float = 0.5, moves: int = 5) -> tuple[np.ndarray, float]:
    """(particles, log evidence): temperatures chosen so that ``keep`` of the effective size survives each step."""
    rng = np.random.default_rng(seed)
    x, b, evidence = reference(rng, n), 0.0, 0.0
    while b < 1:
        ll = log_likelihood(x)
        lo, hi = b, 1.0
        if normalise((hi - b) * ll)[2] < keep * n:
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if normalise((mid - b) * ll)[2] > keep * n else (lo, mid)
        new = hi
        w, z, _ = normalise((new - b) * ll)
        evidence, b = evidence + z, new
        x = x[resample(w, "systematic", rng)]
        step = 2.38 / math.sqrt(x.shape[1]) * np.linalg.cholesky(np.atleast_2d(np.cov(x.T)) + 1e-9 * np.eye(x.shape[1]))
        now = log_prior(x) + b * log_likelihood(x)
        for _ in range(moves):
            y = x + rng.normal(size=x.shape) @ step.T
            then = log_prior(y) + b * log_likelihood(y)
            yes = np.log(rng.random(n)) < then - now
            x[yes], now[yes] = y[yes], then[yes]
    return x, evidence


def chains(spark: SparkSession, log_density: Callable[[np.ndarray], float], start: np.ndarray, chains: int = 4, draws: int = 1000, burn: int = 500, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """(chain, draw, name, value): random-walk Metropolis, one chain a task, seeds in the task rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c in p["chain"]:
                rng = np.random.default_rng([seed, int(c)])
                x = np.array(start, float) + 0.1 * rng.normal(size=len(start))
                now, width, out = log_density(x), scale, []
                for k in range(burn + draws):
                    y = x + width * rng.normal(size=len(x))
                    then = log_density(y)
                    ok = math.log(rng.random()) < then - now
                    if ok:
                        x, now = y, then
                    if k < burn:  # the width is only tuned before draws are kept
                        width *= math.exp((ok - 0.35) / math.sqrt(k + 1))
                    else:
                        out += [(int(c), k - burn, f"x{i}", float(v)) for i, v in enumerate(x)]
                yield pd.DataFrame(out, columns=["chain", "draw", "name", "value"])

    return spark.range(chains).withColumnRenamed("id", "chain").repartition(chains).mapInPandas(run, "chain int, draw long, name string, value double")


def changepoints(series: DataFrame, penalty: float, n_max: int = 20_000) -> DataFrame:
    """(stratum, first, last, mean, n) segments of (stratum, seq, value): least squares with a penalty a segment.

    Exact dynamic programming with pruning of starts that can never be best; one stratum is
    one group of at most ``n_max`` rows.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        if len(g) > n_max:
            raise ValueError(f"a stratum has more than {n_max} rows")
        x, seq = g["value"].to_numpy(float), g["seq"].to_numpy()
        s, q = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
        best, back, live = np.full(len(x) + 1, np.inf), np.zeros(len(x) + 1, int), np.array([0])
        best[0] = -penalty
        for t in range(1, len(x) + 1):
            n = t - live
            cost = best[live] + q[t] - q[live] - (s[t] - s[live]) ** 2 / n
            k = int(cost.argmin())
            best[t], back[t] = cost[k] + penalty, live[k]
            live = np.r_[live[cost <= best[t]], t]
        out, t = [], len(x)
        while t:
            a = back[t]
            out.append((g["stratum"].iloc[0], int(seq[a]), int(seq[t - 1]), float(x[a:t].mean()), t - a))
            t = a
        return pd.DataFrame(out[::-1], columns=["stratum", "first", "last", "mean", "n"])

    kind = dict(series.dtypes)["stratum"]
    return series.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("stratum").applyInPandas(one, f"stratum {kind}, first long, last long, mean double, n long")


def gaussian_process(data: DataFrame, scale: float, noise: float, n_max: int = 3000) -> DataFrame:
    """(stratum, seq, fitted, leave_one_out, sd) of (stratum, seq, x, y): squared-exponential kernel, exact, a group a stratum."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > n_max:
            raise ValueError(f"a stratum has more than {n_max} rows")
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        k = np.exp(-((x[:, None] - x[None]) ** 2) / (2 * scale * scale))
        inverse = np.linalg.inv(k + noise * np.eye(len(x)))
        a = inverse @ (y - y.mean())
        v = 1 / np.diag(inverse)
        return pd.DataFrame({"stratum": g["stratum"], "seq": g["seq"], "fitted": y.mean() + k @ a, "leave_one_out": y - a * v, "sd": np.sqrt(v)})

    kind = dict(data.dtypes)["stratum"]
    return data.groupBy("stratum").applyInPandas(one, f"stratum {kind}, seq long, fitted double, leave_one_out double, sd double")
