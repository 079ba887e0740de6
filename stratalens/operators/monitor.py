"""Order statistics, conformal thresholds and sequential monitors over (stratum, seq, score)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import cumulative
from ..functions.tables import saved


def running_rank(stream: DataFrame, chunk: int | None = None) -> DataFrame:
    """(stratum, seq, score, n, below, tied): places so far, smaller scores before, and equal ones including its own.

    Counting smaller predecessors is sequential, so it is divided: every event belongs to
    a run of ``chunk`` successive places and to a bin of about ``chunk`` scores. Smaller
    predecessors are those of lower bins in earlier runs (a cumulative table of runs by
    bins), of lower bins in its own run (one group), and of its own bin (another group). No
    group exceeds a run or a bin, unless more scores are equal; equal scores share a bin,
    and are counted by their order. Places come from range-partitioned numbering; a chunk of
    the root of the rows (4,096 at least) keeps the table of runs by bins as long as they.
    """
    s = stream.where(~F.isnan("score") & F.col("score").isNotNull())
    s = cumulative(s, ["stratum"], [F.col("seq")], {"n": F.lit(1)})
    s = saved(cumulative(s, ["stratum"], [F.col("score"), F.col("seq")], {"place": F.lit(1)}), "places")
    chunk = chunk or max(4096, math.isqrt(s.count()))
    # equal scores go to the bin of the first of them
    first = s.groupBy("stratum", "score").agg(F.min("place").alias("first"))
    s = s.join(first, ["stratum", "score"])
    s = s.withColumn("run", F.floor((F.col("n") - 1) / chunk)).withColumn("bin", F.floor((F.col("first") - 1) / chunk))
    s = saved(s, "ranks")
    counts = s.groupBy("stratum", "run", "bin").agg(F.count("*").alias("k"))
    # lower bins in earlier runs: cumulate over runs for each bin, then over bins for each run
    grid = s.select("stratum", "run").distinct().join(s.select("stratum", "bin").distinct(), "stratum").join(counts, ["stratum", "run", "bin"], "left").na.fill(0)
    grid = grid.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("stratum", "bin").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grid = grid.withColumn("far", F.coalesce(F.sum("before").over(Window.partitionBy("stratum", "run").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("stratum", "run", "bin", "far")

    def in_run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        b = g["bin"].to_numpy()
        tree = [0] * (int(b.max()) + 2)
        out = []
        for x in b.tolist():
            k, total = x, 0  # bins below x
            while k:
                total += tree[k]
                k &= k - 1
            out.append(total)
            k = x + 1
            while k < len(tree):
                tree[k] += 1
                k += k & -k
        return pd.DataFrame({"stratum": g["stratum"], "n": g["n"], "near": out})

    def in_bin(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        values = g["score"].to_numpy()
        _, rank = np.unique(values, return_inverse=True)
        tree, seen = [0] * (len(values) + 2), [0] * (len(values) + 1)
        low, same = [], []
        for x in rank.tolist():
            k, total = x, 0
            while k:
                total += tree[k]
                k &= k - 1
            seen[x] += 1
            low.append(total)
            same.append(seen[x])
            k = x + 1
            while k < len(tree):
                tree[k] += 1
                k += k & -k
        return pd.DataFrame({"stratum": g["stratum"], "n": g["n"], "own": low, "tied": same})

    kind = dict(s.dtypes)["stratum"]
    near = s.select("stratum", "n", "run", "bin").groupBy("stratum", "run").applyInPandas(in_run, f"stratum {kind}, n long, near long")
    own = s.select("stratum", "n", "bin", "score").groupBy("stratum", "bin").applyInPandas(in_bin, f"stratum {kind}, n long, own long, tied long")
    j = s.join(grid, ["stratum", "run", "bin"]).join(near, ["stratum", "n"]).join(own, ["stratum", "n"])
    return j.select("stratum", "seq", "score", "n", (F.col("far") + F.col("near") + F.col("own")).alias("below"), "tied")


def smoothed_p_values(ranks: DataFrame, theta: Column | float = 1.0) -> DataFrame:
    """Adds p = (below + theta * tied) / n."""
    t = theta if isinstance(theta, Column) else F.lit(float(theta))
    return ranks.withColumn("p", (F.col("below") + t * F.col("tied")) / F.col("n"))


def power_martingale(p_values: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """(stratum, seq, log_capital): running log of the product of epsilon * p^(epsilon - 1)."""
    bet = F.log(F.lit(epsilon)) + (epsilon - 1) * F.log("p")
    return cumulative(p_values.select("stratum", "seq", bet.alias("bet")), ["stratum"], [F.col("seq")], {"log_capital": F.col("bet")}).drop("bet")


def alarms(martingale: DataFrame, level: float = 0.01) -> DataFrame:
    """(stratum, seq): the first time capital reaches 1 / level."""
    return martingale.where(F.col("log_capital") >= -math.log(level)).groupBy("stratum").agg(F.min("seq").alias("seq"))


def split_conformal(scores: DataFrame, alpha: float) -> DataFrame:
    """(stratum, n, k, threshold): the k-th smallest conformity score, k = floor(alpha (n + 1)); minus infinity for k = 0."""
    s = cumulative(scores, ["stratum"], [F.col("score"), F.col("seq")], {"i": F.lit(1)}, total=True).withColumnRenamed("i_all", "n")
    k = F.floor(F.lit(alpha) * (F.col("n") + 1))
    return s.groupBy("stratum").agg(F.max("n").alias("n"), F.max(k).alias("k"), F.coalesce(F.max(F.when(F.col("i") == k, F.col("score"))), F.lit(float("-inf"))).alias("threshold"))


def prediction_intervals(pairs: DataFrame, alpha: float) -> DataFrame:
    """(stratum, n, width): absolute residuals' conformal half-width for (stratum, seq, predicted, actual)."""
    r = pairs.select("stratum", "seq", (-F.abs(F.col("actual") - F.col("predicted"))).alias("score"))
    return split_conformal(r, alpha).select("stratum", "n", (-F.col("threshold")).alias("width"))


def moments(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population variance, skewness and excess kurtosis: mergeable partial sums."""
    v = F.col(value)
    m = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.skewness(v).alias("_skewness"), F.kurtosis(v).alias("_kurtosis"))
    flat = F.col("variance") < 1e-12
    return m.select(*by, "n", "mean", "variance", F.when(flat, 0.0).otherwise(F.col("_skewness")).alias("skewness"), F.when(flat, 0.0).otherwise(F.col("_kurtosis")).alias("kurtosis"))


def weighted_moments(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and variance and the effective sample size."""
    w, x = F.col(weight), F.col(value)
    g = values.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    return g.select(*by, (F.col("wx") / F.col("w")).alias("mean"), (F.col("wxx") / F.col("w") - F.pow(F.col("wx") / F.col("w"), F.lit(2))).alias("variance"), (F.col("w") * F.col("w") / F.col("w2")).alias("effective"))


def split_r_hat(draws: DataFrame) -> DataFrame:
    """(name, r_hat) of (chain, draw, name, value): each chain is halved, so drift within it shows."""
    w = Window.partitionBy("chain", "name")
    h = draws.withColumn("i", F.row_number().over(w.orderBy("draw"))).withColumn("n", F.count("*").over(w))
    h = h.where(F.col("i") <= 2 * F.floor(F.col("n") / 2)).withColumn("half", (F.col("i") > F.floor(F.col("n") / 2)).cast("int"))
    c = h.groupBy("name", "chain", "half").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = c.groupBy("name").agg(F.avg("n").alias("n"), F.avg("v").alias("within"), F.var_samp("m").alias("between"))
    return g.select("name", F.sqrt((F.col("n") - 1) / F.col("n") + F.try_divide(F.col("between"), "within")).alias("r_hat"))


def autocovariance_ess(draws: DataFrame, max_lag: int = 50) -> DataFrame:
    """(name, chain, n, ess): initial positive sequence of autocorrelations up to ``max_lag``."""
    w = Window.partitionBy("chain", "name").orderBy("draw")
    d = draws.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("chain", "name")))
    for k in range(1, max_lag + 1):
        d = d.withColumn(f"l{k}", F.col("c") * F.lag("c", k).over(w))
    g = d.groupBy("name", "chain").agg(F.count("*").alias("n"), F.avg(F.col("c") * F.col("c")).alias("g0"), *[F.sum(f"l{k}").alias(f"g{k}") for k in range(1, max_lag + 1)])
    rho = F.array(*[F.col(f"g{k}") / F.col("n") / F.col("g0") for k in range(1, max_lag + 1)])
    total = F.aggregate(rho, F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("on")), lambda a, r: F.struct(F.when(a["on"] & (r > 0), a["s"] + r).otherwise(a["s"]).alias("s"), (a["on"] & (r > 0)).alias("on")), lambda a: a["s"])
    return g.select("name", "chain", "n", (F.col("n") / (1 + 2 * total)).alias("ess"))


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, cov) with divisor n: every pair of coordinates, from one pass of partial sums.

    Each task adds up outer products a batch at a time, around its first row, and gives
    one row for each coordinate.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross, origin = 0, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist(), np.float64)
            if origin is None:
                origin, total, cross = x[0].copy(), np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
            x = x - origin
            n, total, cross = n + len(x), total + x.sum(0), cross + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total)), "m": pa.array([(origin + total / n).tolist()] * len(total)), "c": pa.array((cross - np.outer(total, total) / n).tolist())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for i, n, m, c in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                m, c = np.array(m), np.array(c)
                if i in held:
                    k, p, q = held[i]
                    held[i] = (k + n, p + (m - p) * n / (k + n), q + c + (m - p) * (m[i] - p[i]) * k * n / (k + n))
                else:
                    held[i] = (n, m, c)
        for i, (n, _, c) in sorted(held.items()):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i] * len(c), pa.int32()), "j": pa.array(range(len(c)), pa.int32()), "cov": pa.array(c / n)})

    parts = points.select("features").mapInArrow(summed, "i int, n long, m array<double>, c array<double>")
    return parts.repartition("i").mapInArrow(merged, "i int, j int, cov double")


def pca(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components by row), largest first; each component's largest coordinate is positive."""
    rows = covariance(points).collect()  # dimension^2 numbers
    n = max(r["i"] for r in rows) + 1
    c = np.zeros((n, n))
    for r in rows:
        c[r["i"], r["j"]] = r["cov"]
    w, v = np.linalg.eigh((c + c.T) / 2)
    v = v[:, ::-1][:, :k].T
    return w[::-1][:k], v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def linear_regression(data: DataFrame, features: list[str], target: str, by: list[str], ridge: float = 0.0) -> DataFrame:
    """(by, coefficients, n): normal equations from one aggregation, solved by group; the intercept comes first."""
    cols = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
    names, aggs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[: i + 1]):
            names.append((i, j))
            aggs.append(F.sum(a * b).alias(f"a{i}_{j}"))
        aggs.append(F.sum(a * F.col(target)).alias(f"b{i}"))
    g = data.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    p = len(cols)

    def solve(parts):
        for t in parts:
            out = []
            for _, r in t.iterrows():
                m = np.zeros((p, p))
                for i, j in names:
                    m[i, j] = m[j, i] = r[f"a{i}_{j}"]
                m[np.arange(1, p), np.arange(1, p)] += ridge
                out.append(np.linalg.lstsq(m, np.array([r[f"b{i}"] for i in range(p)]), rcond=None)[0].tolist())
            yield t[by + ["n"]].assign(coefficients=out)

    kinds = dict(data.dtypes)
    return g.mapInPandas(solve, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, coefficients array<double>")
