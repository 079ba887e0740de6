"""Regressions over tables: penalised splines from sums, samplers by (stratum, chain), sensitivity and change points.

A penalised spline of any number of rows is solved from one pass: tasks add up the banded
Gram matrix. Reversible-jump fits hold a stratum's rows in a task a chain, so a stratum of
more than ``most`` rows is refused; their draws come back as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import splines as sp
from ..functions.tables import saved

#: Rows of a stratum that a sampler may hold.
MOST = 200_000


def _partial(strata: str, x: str, y: str, knots: sp.Knots):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for p in parts:
            for name, g in p.groupby(strata, dropna=False):
                b, r, q, n = sp.banded_sums(g[x].to_numpy(float), g[y].to_numpy(float), knots)
                old = held.get(name)
                held[name] = (b, r, q, n) if old is None else (old[0] + b, old[1] + r, old[2] + q, old[3] + n)
        if held:
            yield pd.DataFrame({"stratum": list(held), "gram": [b.ravel().tolist() for b, *_ in held.values()], "cross": [r.tolist() for _, r, *_ in held.values()], "square": [q for _, _, q, _ in held.values()], "rows": [n for *_, n in held.values()]})

    return run


def spline_sums(data: DataFrame, stratum: str, x: str, y: str, knots: sp.Knots) -> DataFrame:
    """(stratum, gram, cross, square, rows): sums over the basis, one row a task and stratum before they are added up."""
    kind = dict(data.dtypes)[stratum]
    rows = data.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(stratum, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    parts = rows.mapInPandas(_partial(stratum, x, y, knots), f"stratum {kind}, gram array<double>, cross array<double>, square double, rows double")

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": g["stratum"].iloc[:1], "gram": [np.sum(np.stack(g["gram"]), 0).tolist()], "cross": [np.sum(np.stack(g["cross"]), 0).tolist()], "square": [g["square"].sum()], "rows": [g["rows"].sum()]})

    return parts.groupBy("stratum").applyInPandas(merged, f"stratum {kind}, gram array<double>, cross array<double>, square double, rows double")


def penalised_spline(data: DataFrame, stratum: str, x: str, y: str, knots: sp.Knots, lam: float | None = None, order: int = 2) -> DataFrame:
    """(stratum, rows, lambda, edf, sigma2, reml, coefficients) of a P-spline by stratum; without ``lam`` the restricted evidence chooses it."""
    sums = spline_sums(data, stratum, x, y, knots)
    kind = dict(data.dtypes)[stratum]

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for _, r in p.iterrows():
                f = sp.PenalisedFit(sp.unbanded(np.array(r["gram"]).reshape(knots.degree + 1, -1)), np.array(r["cross"]), r["square"], r["rows"], order)
                best = lam if lam is not None else f.best()
                out.append((r["stratum"], r["rows"], best, f.edf(best), f.variance(best), f.reml(best), f.coefficients(best).tolist()))
            yield pd.DataFrame(out, columns=["stratum", "rows", "lambda", "edf", "sigma2", "reml", "coefficients"])

    return sums.mapInPandas(fit, f"stratum {kind}, rows double, lambda double, edf double, sigma2 double, reml double, coefficients array<double>")


def curve(fits: DataFrame, knots: sp.Knots, grid: list[float]) -> DataFrame:
    """(stratum, x, value) of fitted splines on a grid."""
    b = sp.design(np.array(grid), knots)
    rows = F.array(*[F.struct(F.lit(float(g)).alias("x"), F.array(*[F.lit(float(v)) for v in row]).alias("b")) for g, row in zip(grid, b, strict=True)])
    value = F.aggregate(F.zip_with("p.b", "coefficients", lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)
    return fits.select("stratum", "coefficients", F.explode(rows).alias("p")).select("stratum", F.col("p.x").alias("x"), value.alias("value"))


def tensor_spline(data: DataFrame, x: str, y: str, z: str, kx: sp.Knots, ky: sp.Knots, lams: tuple[float, float] | None = None) -> tuple[sp.TensorFit, tuple[float, float], np.ndarray]:
    """(fit, smoothing by axis, coefficients) of z over (x, y), from sums of all rows."""
    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = kx.dimension * ky.dimension
        g, r, q, k = np.zeros((n, n)), np.zeros(n), 0.0, 0
        for p in parts:
            for s in range(0, len(p), 4096):
                part = p.iloc[s : s + 4096]
                b, v = sp.tensor_design(part[x].to_numpy(float), kx, part[y].to_numpy(float), ky), part[z].to_numpy(float)
                g, r, q, k = g + b.T @ b, r + b.T @ v, q + float(v @ v), k + len(part)
        yield pd.DataFrame({"g": [g.ravel().tolist()], "r": [r.tolist()], "q": [q], "k": [float(k)]})

    rows = data.select(*[F.col(c).cast("double").alias(c) for c in (x, y, z)]).na.drop().mapInPandas(summed, "g array<double>, r array<double>, q double, k double")
    n = kx.dimension * ky.dimension
    g, r, q, k = np.zeros((n, n)), np.zeros(n), 0.0, 0.0
    for row in rows.toLocalIterator():  # one row a task, added up one at a time
        g, r, q, k = g + np.array(row["g"]).reshape(n, n), r + np.array(row["r"]), q + row["q"], k + row["k"]
    fit = sp.TensorFit(g, r, q, k, kx.dimension, ky.dimension)
    best = lams or fit.best()
    return fit, best, fit.coefficients(*best)


def _chains(data: DataFrame, stratum: str, columns: list[str], chains: int) -> DataFrame:
    rows = data.select(F.col(stratum).alias("stratum"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    return rows.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))


def free_knots(data: DataFrame, stratum: str, x: str, y: str, grid: list[float], burn: int = 500, keep: int = 1000, chains: int = 2, seed: int = 0, prior: Callable | None = None, df: float | None = None, most: int = MOST) -> DataFrame:
    """(stratum, chain, draw, knots, sigma2, curve): draws of free-knot fits, one chain a task."""
    kind = dict(data.dtypes)[stratum]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"a stratum has more than {most} rows")
        g = g.sort_values([x, y])
        chain = int(g["chain"].iloc[0])
        out = sp.FreeKnots(g[x].to_numpy(), g[y].to_numpy(), prior, df=df, seed=seed * 1009 + chain).run(burn, keep, np.array(grid))
        return pd.DataFrame({"stratum": g["stratum"].iloc[0], "chain": chain, "draw": np.arange(keep), "knots": out["knots"], "sigma2": out["sigma2"], "curve": out["curves"].tolist()})

    return _chains(data, stratum, [x, y], chains).groupBy("stratum", "chain").applyInPandas(run, f"stratum {kind}, chain int, draw long, knots long, sigma2 double, curve array<double>")


def adaptive_surface(data: DataFrame, stratum: str, inputs: list[str], y: str, burn: int = 1000, keep: int = 200, thin: int = 5, chains: int = 2, order: int = 2, seed: int = 0, most: int = MOST) -> DataFrame:
    """(stratum, chain, draw, terms, sigma2, main, total, fitted): draws of an adaptive surface with each input's variance shares."""
    kind = dict(data.dtypes)[stratum]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"a stratum has more than {most} rows")
        g = g.sort_values([*inputs, y])
        chain = int(g["chain"].iloc[0])
        s = sp.Surface(g[inputs].to_numpy(), g[y].to_numpy(), order, seed=seed * 1009 + chain)
        draws = s.run(burn, keep, thin)
        main, total = s.sobol(draws)
        fitted = s.predict(draws, g[inputs].to_numpy())
        return pd.DataFrame({"stratum": g["stratum"].iloc[0], "chain": chain, "draw": np.arange(keep), "terms": [len(t) for t, _, _ in draws], "sigma2": [v for _, _, v in draws], "main": main.tolist(), "total": total.tolist(), "r2": 1 - ((fitted - g[y].to_numpy()) ** 2).mean(1) / max(float(g[y].var(ddof=0)), 1e-300)})

    return _chains(data, stratum, [*inputs, y], chains).groupBy("stratum", "chain").applyInPandas(run, f"stratum {kind}, chain int, draw long, terms long, sigma2 double, main array<double>, total array<double>, r2 double")


def summarise(draws: DataFrame, by: list[str], column: str, probabilities: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(by, draws, mean, sd, quantiles) of a column of draws."""
    return draws.groupBy(*by).agg(F.count(column).alias("draws"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.percentile(column, list(probabilities)).alias("quantiles"))


def equal_tailed(draws: DataFrame, by: list[str], column: str, mass: float = 0.95) -> DataFrame:
    """(by, low, high): the interval that leaves half of the rest on either side."""
    return draws.groupBy(*by).agg(F.percentile(column, (1 - mass) / 2).alias("low"), F.percentile(column, (1 + mass) / 2).alias("high"))


def model_weights(evidence: DataFrame, by: list[str]) -> DataFrame:
    """``evidence`` (by, model, log_evidence, log_prior) with posterior weights, subtracted from the best before exponents."""
    w = Window.partitionBy(*by)
    s = F.col("log_evidence") + F.coalesce(F.col("log_prior"), F.lit(0.0))
    e = evidence.withColumn("_s", s).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def predictive_check(replicates: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """(by, p): share of replicated statistics (by, draw, statistic) at least the observed one (by, statistic); ties count a half."""
    j = replicates.join(observed.withColumnRenamed("statistic", "_o"), by)
    return j.groupBy(*by).agg(F.avg(F.when(F.col("statistic") > F.col("_o"), 1.0).when(F.col("statistic") == F.col("_o"), 0.5).otherwise(0.0)).alias("p"))


# Sensitivity

def pick_freeze(values: DataFrame) -> DataFrame:
    """(input, first, total) of a function from (input, a, b, mixed) rows: values at two independent samples and at the first with one input from the second.

    first = mean of b (mixed - a) over the variance, total = half the mean of (a - mixed)^2 over it.
    """
    g = values.groupBy("input").agg(F.avg(F.col("b") * (F.col("mixed") - F.col("a"))).alias("f"), (F.avg(F.pow(F.col("a") - F.col("mixed"), F.lit(2.0))) / 2).alias("t"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    v = (F.col("va") + F.col("vb")) / 2
    return g.select("input", F.when(v > 0, F.col("f") / v).otherwise(0.0).alias("first"), F.when(v > 0, F.col("t") / v).otherwise(0.0).alias("total"))


def pinned_effect(values: DataFrame, input_column: str, y: str, bins: int) -> DataFrame:
    """(bin, n, effect): the mean of y given an input's bin, less the mean of all: a main effect read off a sample."""
    span = values.agg(F.min(input_column).alias("_lo"), F.max(input_column).alias("_hi"), F.avg(y).alias("_m"))
    x = values.join(F.broadcast(span))  # one row
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    b = F.least(F.floor((F.col(input_column) - F.col("_lo")) / width * bins), F.lit(bins - 1))
    return x.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), (F.avg(y) - F.max("_m")).alias("effect"))


def activity_scores(gradients: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, scores): of the mean outer product of (id, features) gradients; an input's score adds up its squared share of the first k directions times their values."""
    from .linalg import dense, gram

    n = gradients.count()
    w, v = np.linalg.eigh(dense(gram(gradients)) / max(n, 1))
    w, v = w[::-1], v[:, ::-1]
    return w, (v[:, :k] ** 2 * w[:k]).sum(1)


# Change points

def exact_changepoints(series: DataFrame, hazard: float = 0.05, shape: float = 1.0, rate: float = 1.0, precision: float = 0.01, most: int = 5_000) -> DataFrame:
    """(stratum, seq, value, change, mean): chance that a segment begins at each place, and the mean there averaged over all segmentations.

    Segments are normal with a normal-inverse-gamma prior around the stratum's mean, scaled by
    its variance; they end with chance ``hazard`` at each step. Exact forward and backward sums
    over all pairs of ends: quadratic in a stratum, of which more than ``most`` rows are refused.
    """
    kind = dict(series.dtypes)["stratum"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"a stratum has more than {most} rows")
        g = g.sort_values("seq")
        y = g["value"].to_numpy(float)
        n, centre, scale = len(y), float(y.mean()), float(y.std()) or 1.0
        z = (y - centre) / scale
        c1, c2 = np.r_[0, np.cumsum(z)], np.r_[0, np.cumsum(z * z)]

        def log_marginal(i: int) -> tuple[np.ndarray, np.ndarray]:
            """Of segments from i to each later end, and their posterior means."""
            m = np.arange(1, n - i + 1)
            s, q = c1[i + 1 :] - c1[i], c2[i + 1 :] - c2[i]
            k = precision + m
            b = rate + 0.5 * (q - s * s / k)
            gam = np.vectorize(math.lgamma)(shape + m / 2)
            return gam - math.lgamma(shape) + shape * math.log(rate) - (shape + m / 2) * np.log(np.maximum(b, 1e-300)) + 0.5 * np.log(precision / k) - m / 2 * math.log(2 * math.pi), s / k

        logs, means = zip(*(log_marginal(i) for i in range(n)), strict=True)
        stay, end = math.log1p(-hazard), math.log(hazard)
        # tail[i]: log chance of the values from i on, given that a segment begins there
        tail = np.full(n + 1, 0.0)
        for i in range(n - 1, -1, -1):
            length = np.arange(1, n - i + 1)
            terms = logs[i] + (length - 1) * stay + np.where(np.arange(i + 1, n + 1) < n, end, 0.0) + tail[i + 1 :]
            top = terms.max()
            tail[i] = top + math.log(np.exp(terms - top).sum())
        head = np.full(n + 1, -np.inf)  # log chance of the values before i, and that a segment begins there
        head[0] = 0.0
        mean = np.zeros(n + 1)
        for i in range(n):
            length = np.arange(1, n - i + 1)
            out = head[i] + logs[i] + (length - 1) * stay + np.where(np.arange(i + 1, n + 1) < n, end, 0.0)
            head[i + 1 :] = np.logaddexp(head[i + 1 :], out)
            share = np.exp(out + tail[i + 1 :] - tail[0]) * means[i]  # of segments [i, j), by j
            mean[i:n] += np.cumsum(share[::-1])[::-1]
        change = np.exp(head[:n] + tail[:n] - tail[0])
        return pd.DataFrame({"stratum": g["stratum"], "seq": g["seq"], "value": y, "change": np.minimum(change, 1.0), "mean": centre + scale * mean[:n]})

    return series.groupBy("stratum").applyInPandas(run, f"stratum {kind}, seq long, value double, change double, mean double")


# Optimisation and whitening

def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, rounds: int = 500, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """A minimum by moving a simplex: reflection, expansion, contraction, shrinking."""
    n = len(start)
    points = [np.asarray(start, float)] + [np.asarray(start, float) + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], 0)
        far = middle + (middle - points[-1])
        v = f(far)
        if v < values[0]:
            more = middle + 2 * (middle - points[-1])
            w = f(more)
            points[-1], values[-1] = (more, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = middle + 0.5 * ((far if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmin(values))
    return points[k], float(values[k])


def whitened(points: DataFrame) -> DataFrame:
    """(id, features) with mean 0 and unit covariance."""
    from .linalg import pca

    return pca(points, 10**6, whiten=True)["table"]
