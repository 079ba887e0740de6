"""Queries over regressions that SQL can follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splines
from ..functions.tables import saved
from ..operators import regression
from . import Registry, table

R = Registry()

_HATS = "h AS (SELECT event_type AS stratum, least(greatest(value, 0), 1000) AS x, value AS y FROM events WHERE value IS NOT NULL)"


@R.add(f"WITH {_HATS}, b AS (SELECT stratum, j, greatest(0, 1 - abs(x - 100.0 * j) / 100.0) AS b, y FROM h, range(0, 11) r(j)) SELECT stratum, j, round(sum(b), 6) AS mass, round(sum(b * y), 4) AS weighted, round(sum(b * b), 6) AS square FROM b GROUP BY stratum, j")
def hat_basis(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a linear spline basis of events' values with ten pieces."""
    k = splines.Knots.even(10, 0.0, 1000.0, 1)
    e = table(spark, d, "events").select("event_type", F.least(F.greatest("value", F.lit(0.0)), F.lit(1000.0)).alias("x"), "value")
    ones = regression.spline_sums(e.withColumn("one", F.lit(1.0)), "event_type", "x", "one", k).select("stratum", F.posexplode("cross").alias("j", "mass"))
    s = saved(regression.spline_sums(e, "event_type", "x", "value", k), "hats")
    w = s.select("stratum", F.posexplode("cross").alias("j", "weighted"))
    q = s.select("stratum", F.posexplode(F.slice("gram", 1, 11)).alias("j", "square"))
    j = ones.join(w, ["stratum", "j"]).join(q, ["stratum", "j"])
    return j.select("stratum", F.col("j").cast("long").alias("j"), F.round("mass", 6).alias("mass"), F.round("weighted", 4).alias("weighted"), F.round("square", 6).alias("square"))


@R.add("WITH f AS (SELECT l_returnflag AS stratum, regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY l_returnflag) SELECT stratum, CAST(x AS DOUBLE) AS x, round(a + b * x, 1) AS value FROM f, (SELECT unnest([1, 10, 20, 30, 40, 50]) AS x)")
def smoothest_curve(spark: SparkSession, d: str) -> DataFrame:
    """A penalised cubic spline of price over quantity, smoothed without end: the regression line."""
    k = splines.Knots.even(6, 1.0, 50.0, extended=True)
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    c = regression.curve(regression.penalised_spline(t, "l_returnflag", "l_quantity", "l_extendedprice", k, lam=1e11), k, [1.0, 10.0, 20.0, 30.0, 40.0, 50.0])
    return c.withColumn("value", F.round("value", 1))


@R.add("WITH w AS (SELECT l_returnflag AS stratum, count(*) AS n, sum(CAST(l_extendedprice AS DOUBLE)) AS s, sum(CAST(l_extendedprice AS DOUBLE) * l_extendedprice) AS q FROM lineitem GROUP BY l_returnflag) SELECT stratum, CAST(n AS DOUBLE) AS rows, round(s, 1) AS total, round(q / 1e6, 1) AS square, 0.0::DOUBLE AS residual FROM w")
def price_curve(spark: SparkSession, d: str) -> DataFrame:
    """A penalised spline of price over quantity by flag: what its sums add up to, and how far its coefficients are from the normal equations."""
    k = splines.Knots.even(12, 1.0, 50.0, extended=True)
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    s = saved(regression.spline_sums(t, "l_returnflag", "l_quantity", "l_extendedprice", k), "sums")
    f = regression.penalised_spline(t, "l_returnflag", "l_quantity", "l_extendedprice", k).select("stratum", "lambda", "coefficients")

    @F.pandas_udf("double")
    def left(gram: pd.Series, cross: pd.Series, lam: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for g, r, m, b in zip(gram, cross, lam, c, strict=True):
            r, b = np.array(r), np.array(b)
            a = splines.unbanded(np.array(g).reshape(k.degree + 1, -1)) + m * splines.penalty(len(b))
            out.append(round(float(np.abs(a @ b - r).max() / np.abs(r).max()), 6) + 0.0)
        return pd.Series(out)

    j = s.join(f, "stratum")
    return j.select("stratum", "rows", F.round(F.aggregate("cross", F.lit(0.0), lambda a, x: a + x), 1).alias("total"), F.round(F.col("square") / 1e6, 1).alias("square"), left("gram", "cross", "lambda", "coefficients").alias("residual"))


@R.add("WITH p AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders), v AS (SELECT i, a / 1e5 + b / 1e4 AS fa, b / 1e5 + a / 1e4 AS fb, CASE WHEN i = 0 THEN b / 1e5 + b / 1e4 ELSE a / 1e5 + a / 1e4 END AS fm FROM p, range(0, 2) r(i)) SELECT CAST(i AS INT) AS input, round(avg(fb * (fm - fa)) / ((var_pop(fa) + var_pop(fb)) / 2), 6) AS first, round(avg(pow(fa - fm, 2)) / 2 / ((var_pop(fa) + var_pop(fb)) / 2), 6) AS total FROM v GROUP BY i")
def sensitivity_shares(spark: SparkSession, d: str) -> DataFrame:
    """Pick-and-freeze shares of a linear function of an order's price and customer."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    f = lambda x, y: x / 1e5 + y / 1e4
    a, b = F.col("a"), F.col("b")
    rows = o.select(F.explode(F.array(*[F.struct(F.lit(i).alias("input"), f(a, b).alias("a"), f(b, a).alias("b"), m.alias("mixed")) for i, m in ((0, f(b, b)), (1, f(a, a)))])).alias("r")).select("r.*")
    s = regression.pick_freeze(rows)
    return s.select("input", F.round("first", 6).alias("first"), F.round("total", 6).alias("total"))


@R.add("WITH s AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi, avg(CAST(l_extendedprice AS DOUBLE)) AS m FROM lineitem) SELECT CAST(least(floor((l_discount - lo) / (hi - lo) * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(CAST(l_extendedprice AS DOUBLE)) - max(m), 4) AS effect FROM lineitem, s GROUP BY ALL")
def discount_effect(spark: SparkSession, d: str) -> DataFrame:
    """How the mean price moves with the discount's fifth."""
    t = table(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return regression.pinned_effect(t, "x", "y", 5).withColumn("effect", F.round("effect", 4))


@R.add("WITH g AS (SELECT l_returnflag, l_linestatus AS model, CAST(count(*) AS DOUBLE) / 100 AS e FROM lineitem GROUP BY ALL) SELECT l_returnflag, model, round(exp(e - max(e) OVER (PARTITION BY l_returnflag)) / sum(exp(e)) OVER (PARTITION BY l_returnflag) * exp(max(e) OVER (PARTITION BY l_returnflag)), 6) AS weight FROM g")
def evidence_weights(spark: SparkSession, d: str) -> DataFrame:
    """Posterior weights of two models by flag, from log evidences that are hundredths of line counts."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linestatus").alias("model")).agg((F.count("*") / 100.0).alias("log_evidence")).withColumn("log_prior", F.lit(0.0))
    return regression.model_weights(g, ["l_returnflag"]).select("l_returnflag", "model", F.round("weight", 6).alias("weight"))


@R.add("SELECT event_type, count(value) AS draws, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def draw_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and central interval of every type's values, as of a column of draws."""
    e = table(spark, d, "events")
    s = regression.summarise(e, ["event_type"], "value")
    i = regression.equal_tailed(e, ["event_type"], "value")
    return s.join(i, "event_type").select("event_type", "draws", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])
