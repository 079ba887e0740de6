"""Conformal sets, predictive laws and risk bounds over tables of scores.

Scores are conformities: higher conforms better. Calibration tables hold (stratum, seq,
score); places and running weights come from range-partitioned sums, so a stratum is
never sorted in one task. A threshold of minus infinity is the whole space.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import Beta
from ..functions.ordering import cumulative
from ..functions.tables import saved

INF = float("inf")


def level(units: int, alpha: float) -> int:
    """k = floor(alpha (n + 1)) from n + 1 units."""
    return math.floor(alpha * units + 1e-12)


# Training-conditional law of a split set

def miscoverage(units: int, k: int, beta: float) -> float:
    """What a set's own miscoverage stays below with chance ``beta``: the quantile of Beta(k, units - k); 0 for k = 0."""
    return float(Beta(a=float(k), b=float(units - k)).quantile(beta)[0]) if 0 < k < units else float(k > 0)


def safe_level(units: int, alpha: float, beta: float) -> int:
    """The greatest level whose :func:`miscoverage` is at most ``alpha`` (0: the whole space); it falls with the level, so it is bisected."""
    lo, hi = 0, level(units, alpha)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if miscoverage(units, mid, beta) <= alpha else (lo, mid - 1)
    return lo


# Thresholds

def ordered(scores: DataFrame) -> DataFrame:
    """(stratum, seq, score, i, n): places in ascending order."""
    return cumulative(scores.select("stratum", "seq", "score"), ["stratum"], [F.col("score"), F.col("seq")], {"i": F.lit(1)}, total=True).withColumnRenamed("i_all", "n")


def at_levels(places: DataFrame, levels: DataFrame) -> DataFrame:
    """(stratum, name, k, score): the k-th smallest score; levels are (stratum, name, k), k = 0 gives minus and k > n plus infinity."""
    j = levels.join(places.select("stratum", F.col("i").alias("k"), "score"), ["stratum", "k"], "left")
    return j.select("stratum", "name", "k", F.when(F.col("k") <= 0, -INF).otherwise(F.coalesce("score", F.lit(INF))).alias("score"))


def asymmetric_intervals(pairs: DataFrame, alpha: float) -> DataFrame:
    """(stratum, n, k, below, above): two-tailed margins for quantile readings (stratum, seq, low, high, actual).

    Each tail is ranked at alpha / 2; a case's interval is [low - below, high + above].
    """
    low = saved(ordered(pairs.select("stratum", "seq", (F.col("actual") - F.col("low")).alias("score"))), "low")
    high = saved(ordered(pairs.select("stratum", "seq", (F.col("high") - F.col("actual")).alias("score"))), "high")
    k = low.groupBy("stratum").agg(F.max("n").alias("n")).withColumn("k", F.floor(F.lit(alpha / 2) * (F.col("n") + 1)))
    pick = lambda p: at_levels(p, k.select("stratum", F.lit("x").alias("name"), "k")).select("stratum", (-F.col("score")).alias("m"))
    return k.join(pick(low).withColumnRenamed("m", "below"), "stratum").join(pick(high).withColumnRenamed("m", "above"), "stratum").select("stratum", "n", "k", "below", "above")


def group_threshold(scores: DataFrame, alpha: float, worst: bool = True) -> DataFrame:
    """(stratum, n, k, threshold) where a group of rows (stratum, unit, score) is one unit: its least score, or its mean."""
    from .monitor import split_conformal

    g = scores.groupBy("stratum", F.col("unit").alias("seq")).agg((F.min if worst else F.avg)("score").alias("score"))
    return split_conformal(g, alpha)


def weighted_thresholds(calibration: DataFrame, cases: DataFrame, alpha: float) -> DataFrame:
    """(stratum, case, weight, threshold) for cases (stratum, case, weight) under weights of calibration rows (stratum, seq, score, weight).

    A score is refused while the weight of the units at most it, the case's own included, is
    at most alpha of the total with it. A case finds its place among running weights by one
    sorted pass over both.
    """
    c = cumulative(calibration, ["stratum"], [F.col("score"), F.col("seq")], {"i": F.lit(1), "w": F.col("weight")}, total=True)
    c = saved(c.select("stratum", "score", "i", "w", F.col("w_all").alias("all")), "weights")
    total = c.groupBy("stratum").agg(F.max("all").alias("all"))
    t = cases.join(total, "stratum", "left").na.fill(0.0, ["all"]).withColumn("key", alpha * F.col("all") - (1 - alpha) * F.col("weight"))
    kind = dict(cases.dtypes)["case"]
    both = c.select("stratum", F.col("w").alias("key"), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("case"), F.lit(1).alias("one"), F.lit(0.0).alias("weight"))
    both = both.unionByName(t.select("stratum", "key", F.lit(1).alias("side"), "case", F.lit(0).alias("one"), "weight"))
    # calibration rows whose running weight is at most the key come first; the next one is accepted
    j = cumulative(both, ["stratum"], [F.col("key"), F.col("side"), F.col("case")], {"passed": F.col("one")}).where("side = 1")
    j = j.select("stratum", "case", "weight", "key", (F.col("passed") + 1).alias("i")).join(c.select("stratum", "i", "score"), ["stratum", "i"], "left")
    return j.select("stratum", "case", "weight", F.when(F.col("key") < 0, -INF).otherwise(F.coalesce("score", F.lit(INF))).alias("threshold"))


def weighted_p_values(calibration: DataFrame, cases: DataFrame) -> DataFrame:
    """(stratum, case, score, p): p = (weight of units scoring at most the case's score + its own) / total with its own, for cases (stratum, case, score, weight)."""
    kind = dict(cases.dtypes)["case"]
    both = calibration.select("stratum", "score", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("case"), "weight", F.col("weight").alias("own"))
    both = both.unionByName(cases.select("stratum", "score", F.lit(1).alias("side"), "case", "weight", F.lit(0.0).alias("own")))
    j = cumulative(both, ["stratum"], [F.col("score"), F.col("side"), F.col("case"), F.col("weight")], {"w": F.col("own")}, total=True)
    return j.where("side = 1").select("stratum", "case", "score", ((F.col("w") + F.col("weight")) / (F.col("w_all") + F.col("weight"))).alias("p"))


# Predictive laws

def predictive_cdf(residuals: DataFrame, cases: DataFrame) -> DataFrame:
    """(stratum, case, lower, upper, mid) of a split predictive law at each case's value.

    ``residuals`` (stratum, seq, residual) are calibration errors, ``cases`` (stratum, case, residual)
    values less their predictions: lower = #{below} / (n + 1), upper = (#{at most} + 1) / (n + 1).
    """
    kind = dict(cases.dtypes)["case"]
    rows = residuals.select("stratum", "residual", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("case"), F.lit(1).alias("one"))
    for side in (0, 2):  # before and behind equal residuals
        rows = rows.unionByName(cases.select("stratum", "residual", F.lit(side).alias("side"), "case", F.lit(0).alias("one")))
    j = saved(cumulative(rows, ["stratum"], [F.col("residual"), F.col("side"), F.col("case")], {"k": F.col("one")}, total=True).where("side <> 1"), "law")
    g = j.groupBy("stratum", "case").agg(F.min("k").alias("below"), F.max("k").alias("upto"), F.max("k_all").alias("n"))
    lower, upper = F.col("below") / (F.col("n") + 1), (F.col("upto") + 1) / (F.col("n") + 1)
    return g.select("stratum", "case", lower.alias("lower"), upper.alias("upper"), ((lower + upper) / 2).alias("mid"))


def pit_calibration(pits: DataFrame, cases: DataFrame) -> DataFrame:
    """(stratum, case, pit, calibrated): cases' probability-integral transforms ranked among the calibration units', which corrects a law that is too wide or too narrow."""
    p = predictive_cdf(pits.select("stratum", "seq", F.col("pit").alias("residual")), cases.select("stratum", "case", F.col("pit").alias("residual")))
    return cases.join(p.select("stratum", "case", F.col("mid").alias("calibrated")), ["stratum", "case"])


def averaged_scores(densities: DataFrame, weights: DataFrame) -> DataFrame:
    """(stratum, seq, score): the log of the models' averaged density, from (stratum, seq, model, log_density) and (model, log_weight)."""
    top = weights.agg(F.max("log_weight").alias("_top"))
    w = weights.join(F.broadcast(top)).withColumn("_w", F.exp(F.col("log_weight") - F.col("_top")))  # one row; a row a model
    share = w.withColumn("share", F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(0)))).select("model", "share")
    best = densities.groupBy("stratum", "seq").agg(F.max("log_density").alias("best"))
    j = densities.join(share, "model").join(best, ["stratum", "seq"])
    return j.groupBy("stratum", "seq").agg((F.max("best") + F.log(F.sum(F.col("share") * F.exp(F.col("log_density") - F.col("best"))))).alias("score"))


# Cross-conformal intervals

#: Held-out residuals that travel with the tasks.
RESIDUALS = 2_000_000


def cv_plus(residuals: DataFrame, predictions: DataFrame, alpha: float, most: int = RESIDUALS) -> DataFrame:
    """(case, n, k, lower, upper): CV+ intervals from held-out residuals (fold, residual) and each fold's predictions of the cases (case, fold, prediction).

    lower is the k-th smallest of prediction - |residual| over all units, upper the k-th
    greatest of prediction + |residual|, k = floor(alpha (n + 1)); with a fold a unit this is the
    jackknife+. Up to ``most`` residuals travel, sorted by fold, and a case's end is bisected
    over them; beyond that every case meets every unit by an equi-join on the fold.
    """
    n = residuals.count()
    k = level(n + 1, alpha)
    kinds = dict(predictions.dtypes)
    if k == 0:
        return predictions.select("case").distinct().select("case", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(-INF).alias("lower"), F.lit(INF).alias("upper"))
    if n > most:
        j = predictions.join(residuals, "fold")
        ends = []
        for name, value, order in (("lower", F.col("prediction") - F.abs("residual"), F.asc), ("upper", F.col("prediction") + F.abs("residual"), F.desc)):
            r = j.select("case", value.alias("x")).withColumn("i", F.row_number().over(Window.partitionBy("case").orderBy(order("x"))))
            ends.append(r.where(F.col("i") <= k).groupBy("case").agg((F.max if name == "lower" else F.min)("x").alias(name)))
        return ends[0].join(ends[1], "case").select("case", F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), "lower", "upper")
    held: dict = {}
    for r in residuals.select("fold", F.abs("residual").alias("r")).toLocalIterator():
        held.setdefault(r["fold"], []).append(r["r"])
    sent = residuals.sparkSession.sparkContext.broadcast({f: np.sort(np.array(x)) for f, x in held.items()})

    def ends_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for m in p["by"]:
                means = {x["fold"]: x["prediction"] for x in m}
                lists = [(means[f], r) for f, r in sent.value.items() if f in means]

                def kth(sign: float) -> float:
                    """The k-th smallest of sign * (mean + sign * r) ... by counting how many lie at or below a value."""
                    every = [(sign * mu, r) for mu, r in lists]  # values sign * mu - ... for both ends: -(r - sign mu)
                    lo, hi = min(mu - r[-1] for mu, r in every), max(mu - r[0] for mu, r in every)
                    count = lambda t: sum(len(r) - int(np.searchsorted(r, mu - t, "left")) for mu, r in every)
                    for _ in range(200):
                        mid = (lo + hi) / 2
                        if mid in (lo, hi):
                            break
                        lo, hi = (lo, mid) if count(mid) >= k else (mid, hi)
                    # the value itself, free of rounding in the search: the greatest at or below hi
                    return max(mu - r[i] for mu, r in every for i in [int(np.searchsorted(r, mu - hi, "left"))] if i < len(r))

                out.append((kth(1.0), -kth(-1.0)))
            yield pd.DataFrame({"case": p["case"], "n": n, "k": k, "lower": [x for x, _ in out], "upper": [x for _, x in out]})

    by = predictions.groupBy("case").agg(F.collect_list(F.struct("fold", "prediction")).alias("by"))
    return by.mapInPandas(ends_of, f"case {kinds['case']}, n long, k long, lower double, upper double")


def leave_one_out(data: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``data`` with its leave-one-out residual under a line fitted by stratum: residual / (1 - leverage), from one aggregation."""
    g = data.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.covar_pop(x, y).alias("_c"))
    j = data.join(g, by)
    slope = F.when(F.col("_vx") > 0, F.col("_c") / F.col("_vx")).otherwise(0.0)
    lever = 1 / F.col("_n") + F.when(F.col("_vx") > 0, (F.col(x) - F.col("_mx")) ** 2 / (F.col("_n") * F.col("_vx"))).otherwise(0.0)
    residual = F.col(y) - F.col("_my") - slope * (F.col(x) - F.col("_mx"))
    return j.withColumn("loo", F.when(lever < 1, residual / (1 - lever))).drop("_n", "_mx", "_my", "_vx", "_c")


# Batches of test units

def rank_law(n: int, m: int, order: int) -> np.ndarray:
    """Chance that the ``order``-th smallest of m test scores has rank 1 .. n + 1 among n calibration scores."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return np.array([math.exp(choose(k + order - 2, order - 1) + choose(n + m - k - order + 1, m - order) - choose(n + m, m)) for k in range(1, n + 2)])


def batch_ranks(n: int, m: int, order: int, below: float, above: float) -> tuple[int, int, float]:
    """(lower rank, upper rank, coverage): the batch's order statistic lies between the scores before the lower rank and at the upper one."""
    total = math.comb(n + m, m)

    def upto(k: int) -> int:
        """Of ``total`` arrangements, those with a rank of at most k: ``order`` or more test scores before the k-th calibration score."""
        if k <= 0 or k > n:
            return total if k > n else 0
        return sum(math.comb(k - 1 + j, j) * math.comb(n - k + m - j, m - j) for j in range(order, m + 1))

    # whole numbers: logarithms of factorials lose nine digits at a million scores
    over, under = Fraction(above + 1e-12) * total, Fraction(below + 1e-12) * total
    upper = 1 + bisect_left(range(1, n + 1), True, key=lambda k: total - upto(k) <= over)
    lower = bisect_left(range(1, n + 2), True, key=lambda k: upto(k) > under) + 1  # ranks before may be given up
    return lower, upper, (upto(upper) - upto(lower - 1)) / total


def batch_quantile(scores: DataFrame, m: int, order: int, below: float, above: float) -> DataFrame:
    """(stratum, n, lower_rank, upper_rank, lower, upper, coverage) for the order-th smallest score of m test units."""
    p = saved(ordered(scores), "places")
    sizes = p.groupBy("stratum").agg(F.max("n").alias("n")).collect()  # one row a stratum
    rows = [(r["stratum"], r["n"], *batch_ranks(r["n"], m, order, below, above)) for r in sizes]
    kind = dict(p.dtypes)["stratum"]
    ranks = scores.sparkSession.createDataFrame(rows, f"stratum {kind}, n long, lower_rank long, upper_rank long, coverage double")
    ends = ranks.select("stratum", F.lit("lower").alias("name"), (F.col("lower_rank") - 1).alias("k")).unionByName(ranks.select("stratum", F.lit("upper").alias("name"), F.col("upper_rank").alias("k")))
    e = at_levels(p, ends)
    wide = e.groupBy("stratum").agg(F.max(F.when(F.col("name") == "lower", F.col("score"))).alias("lower"), F.max(F.when(F.col("name") == "upper", F.col("score"))).alias("upper"))
    return ranks.join(wide, "stratum").select("stratum", "n", "lower_rank", "upper_rank", "lower", "upper", "coverage")


def box_coverage(n: int, m: int, bounds: dict[int, tuple[int, int]]) -> float:
    """Chance that all order statistics named have ranks within their bounds: sequences 1 <= r_1 <= ... <= r_m <= n + 1, counted place by place."""
    ways = [1] * (n + 1)
    for j in range(1, m + 1):
        if j > 1:
            total, run = 0, []
            for x in ways:
                total += x
                run.append(total)
            ways = run
        lo, hi = bounds.get(j, (1, n + 1))
        ways = [x if lo <= r <= hi else 0 for r, x in enumerate(ways, 1)]
    return sum(ways) / math.comb(n + m, m)


def simultaneous(n: int, m: int, orders: list[int], alpha: float) -> dict[int, tuple[int, int]]:
    """Bounds on several order statistics that hold together with chance 1 - alpha: equal tails for each, the widest error share that still covers."""
    def at(share: float) -> dict[int, tuple[int, int]]:
        return {o: batch_ranks(n, m, o, share / 2, share / 2)[:2] for o in orders}

    lo, hi = alpha / len(orders), alpha  # Bonferroni covers, alpha for each is the most there could be
    best = at(lo)
    for _ in range(30):
        mid = (lo + hi) / 2
        b = at(mid)
        if box_coverage(n, m, b) >= 1 - alpha:
            lo, best = mid, b
        else:
            hi = mid
    return best


# Risk bounds

class LossBound:
    """The law of a Dirichlet-weighted mean of losses and their bound, whose upper quantiles bound the risk."""

    def __init__(self, losses, bound: float):
        self.knots = np.sort(np.r_[np.asarray(losses, float), bound])
        if self.knots[0] < 0 or self.knots[-1] > bound:
            raise ValueError("losses must lie in [0, bound]")

    @property
    def mean(self) -> float:
        return float(self.knots.mean())

    def below(self, x: float) -> float:
        """P(L <= x): the integral of the B-spline on the losses as knots, by de Boor's triangle on 0 and 1."""
        t, n = self.knots, len(self.knots) - 1
        if x < t[0]:
            return 0.0
        if x >= t[-1]:
            return 1.0
        if n == 0:
            return 1.0
        last = int(np.searchsorted(t, x, "right")) - 1  # t[last] <= x < t[last + 1]
        # coefficients of the step spline: 1 for splines that begin at the first knot or behind it
        span = max(t[-1] - t[0], 1.0)
        pad = np.r_[t[0] - span * np.arange(n, 0, -1), t, t[-1] + span * np.arange(1, n + 1)]
        at, p = last + n, n
        d = np.array([1.0 if j >= n else 0.0 for j in range(at - p, at + 1)])
        for r in range(1, p + 1):
            j = np.arange(at - p + r, at + 1)
            width = pad[j + p - r + 1] - pad[j]
            a = np.divide(x - pad[j], width, out=np.zeros(len(j)), where=width > 0)
            d[r:] = (1 - a) * d[r - 1 : -1] + a * d[r:]
        return float(min(1.0, max(0.0, d[-1])))

    def gaffke(self, beta: float) -> float:
        """The least x with P(L <= x) >= beta: an upper confidence bound on the mean loss."""
        lo, hi = float(self.knots[0]), float(self.knots[-1])
        if self.below(lo) >= beta:
            return lo
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if self.below(mid) >= beta else (mid, hi)
        return hi


def binary_bound(wrong: int, n: int, beta: float) -> float:
    """The same for 0/1 losses, at any size: the quantile of Beta(wrong + 1, n - wrong)."""
    return 1.0 if wrong >= n else float(Beta(a=float(wrong + 1), b=float(n - wrong)).quantile(beta)[0])


def risk_threshold(losses: DataFrame, alpha: float, beta: float | None = None, bound: float = 1.0) -> DataFrame:
    """(grid, n, reading, chosen): the first grid value whose reading is at most alpha, for (grid, unit, loss) with losses falling along the grid.

    The reading is (sum + bound) / (n + 1); with ``beta`` the upper confidence bound of 0/1 losses at that confidence.
    """
    g = losses.groupBy("grid").agg(F.count("*").alias("n"), F.sum("loss").cast("double").alias("s"))
    if beta is None:
        r = g.select("grid", "n", ((F.col("s") + bound) / (F.col("n") + 1)).alias("reading"))
    else:
        @F.pandas_udf("double")
        def bounds(s: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([binary_bound(round(a), int(b), beta) for a, b in zip(s, n, strict=True)])

        r = g.select("grid", "n", bounds("s", "n").alias("reading"))
    first = F.min(F.when(F.col("reading") <= alpha, F.col("grid"))).over(Window.partitionBy(F.lit(0)))  # a row a grid value
    return r.withColumn("chosen", F.coalesce(F.col("grid") == first, F.lit(False)))


def high_density_level(scores: DataFrame, alpha: float, confidence: float) -> DataFrame:
    """(stratum, n, k, threshold): the density above which a set misses more than alpha with chance at most 1 - confidence."""
    p = saved(ordered(scores), "places")
    sizes = p.groupBy("stratum").agg(F.max("n").alias("n")).collect()  # one row a stratum
    kind = dict(p.dtypes)["stratum"]
    k = scores.sparkSession.createDataFrame([(r["stratum"], r["n"], safe_level(r["n"] + 1, alpha, confidence)) for r in sizes], f"stratum {kind}, n long, k long")
    t = at_levels(p, k.select("stratum", F.lit("x").alias("name"), "k")).select("stratum", F.col("score").alias("threshold"))
    return k.join(t, "stratum")


def boundary(accepted, lo: float, hi: float, steps: int = 60) -> float:
    """Where a set ends between an accepted and a refused value, by bisection."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if accepted(mid) else (lo, mid)
    return (lo + hi) / 2


# Streams

class OrderStatistics:
    """Scores seen so far: how many lie below a new one, and how many equal it with itself."""

    def __init__(self):
        self.seen: list[float] = []

    def add(self, x: float) -> tuple[int, int]:
        a = bisect_left(self.seen, x)
        b = bisect_right(self.seen, x)
        insort(self.seen, x)
        return a, b - a + 1


def inclusion(weights: np.ndarray, k: int) -> np.ndarray:
    """Chance that each unit is among k drawn with chances in proportion to products of weights: conditional Poisson sampling.

    The weights are tilted so that k are expected, which keeps every term of the
    Poisson-binomial law in range.
    """
    w = np.asarray(weights, float)
    live = w > 0
    if k >= live.sum():
        return live.astype(float)
    lo, hi = -700.0, 700.0
    logw = np.log(w[live])
    for _ in range(200):
        mid = (lo + hi) / 2
        a = 1 / (1 + np.exp(-(logw + mid)))
        lo, hi = (mid, hi) if a.sum() < k else (lo, mid)
    odds = np.exp(logw + (lo + hi) / 2)
    a = odds / (1 + odds)
    law = np.zeros(k + 1)
    law[0] = 1.0
    for x in a:
        law[1:] = law[1:] * (1 - x) + law[:-1] * x
        law[0] *= 1 - x
    out = np.zeros(len(w))
    out[live] = [x * _without(a, i, k - 1) / law[k] for i, x in enumerate(a)]
    return out


def _without(a: np.ndarray, i: int, k: int) -> float:
    law = np.zeros(k + 1)
    law[0] = 1.0
    for j, x in enumerate(a):
        if j != i:
            law[1:] = law[1:] * (1 - x) + law[:-1] * x
            law[0] *= 1 - x
    return float(law[k])


class ShiftedPValues:
    """Smoothed p-values of a stream whose units follow the reference law reweighted by a known ratio."""

    def __init__(self, reference: np.ndarray, weights: np.ndarray, seed: int = 0):
        self.scores, self.weights = list(map(float, reference)), list(map(float, weights))
        self.count, self.rng = 0, np.random.default_rng(seed)

    def add(self, score: float, weight: float) -> float:
        if not weight > 0:
            raise ValueError("a unit of the stream needs a positive weight")
        self.scores.append(float(score))
        self.weights.append(float(weight))
        self.count += 1
        p = inclusion(np.array(self.weights), self.count) / self.count
        s = np.array(self.scores)
        return float(p[s < score].sum() + (1 - self.rng.random()) * p[s == score].sum())


# Shift

def density_ratio(source: DataFrame, target: DataFrame, features: list[str], ridge: float = 1e-6, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients (intercept first) of the log ratio target / source, by logistic regression: Newton steps whose sums are one aggregation each."""
    both = source.select(F.lit(0.0).alias("_y"), *features).unionByName(target.select(F.lit(1.0).alias("_y"), *features))
    both = saved(both, "ratio")
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    p = len(cols)
    beta = np.zeros(p)
    for _ in range(rounds):
        eta = sum((c * float(b) for c, b in zip(cols[1:], beta[1:], strict=True)), F.lit(float(beta[0])))
        mu = 1 / (1 + F.exp(-eta))
        sums = [F.sum((F.col("_y") - mu) * a).alias(f"g{i}") for i, a in enumerate(cols)] + [F.sum(mu * (1 - mu) * a * b).alias(f"h{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols[: i + 1])]
        r = both.agg(*sums, F.sum("_y").alias("t"), F.count("*").alias("n")).first()
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        penalty = np.r_[0.0, np.full(p - 1, ridge)]
        step = np.linalg.solve(h + np.diag(penalty + 1e-12), np.array([r[f"g{i}"] for i in range(p)]) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    beta[0] -= math.log(r["t"] / (r["n"] - r["t"]))  # class sizes are not part of the ratio
    return beta


def ratio_column(beta: np.ndarray, features: list[str]) -> Column:
    return F.exp(sum((F.col(f).cast("double") * float(b) for f, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0]))))
