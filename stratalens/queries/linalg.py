"""Queries over products, Gram matrices and spectra of tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg
from . import Registry, table
from .graph import points

R = Registry()

_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LIST = ", ".join(f"CAST({c} AS DOUBLE)" for c in _X)


@R.add(f"WITH x AS (SELECT [{_LIST}] AS v FROM lineitem) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(v[i + 1] * v[j + 1]), 2) AS v FROM x, range(0, 4) a(i), range(0, 4) b(j) GROUP BY i, j")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of a line's four numbers."""
    rows = table(spark, d, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _X]).alias("features"))
    return linalg.gram(rows).select("i", "j", F.round("v", 2).alias("v"))


@R.add("SELECT CAST(n_regionkey AS INT) AS i, CAST(s AS INT) AS j, CAST(count(*) AS DOUBLE) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) - 1 AS s FROM (SELECT DISTINCT c_mktsegment FROM customer)) ON seg = c_mktsegment GROUP BY n_regionkey, s")
def region_segments(spark: SparkSession, d: str) -> DataFrame:
    """Regions by nations times nations by market segments: a sparse product counts customers."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # a few segments
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("c_mktsegment")) - 1
    a = n.select(F.col("n_regionkey").cast("int").alias("i"), F.col("n_nationkey").cast("int").alias("j"), F.lit(1.0).alias("v"))
    b = c.groupBy(F.col("c_nationkey").cast("int").alias("i"), number.cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return linalg.product(a, b)


@R.add("WITH g AS (SELECT event_type, avg(value) AS m, var_samp(value) AS v, avg(user_id) AS mu, var_samp(user_id) AS vu FROM events GROUP BY event_type) SELECT event_id, round(sqrt(pow(value - m, 2) / v + pow(user_id - mu, 2) / vu), 6) AS distance FROM events JOIN g USING (event_type)")
def scaled_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far an event lies from its type's mean, in standard deviations of its value and user."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.col("user_id").cast("double").alias("user_id"))
    return linalg.scaled_distance(e, ["event_type"], ["value", "user_id"]).select("event_id", F.round("distance", 6).alias("distance"))


@R.add("WITH s AS (SELECT o_orderpriority AS stratum, year(o_orderdate) * 12 + month(o_orderdate) - 1992 * 12 - 1 AS t, count(*) AS x FROM orders GROUP BY ALL), p AS (SELECT stratum, k, sum(x * cos(2 * pi() * k * t / 128)) AS re, sum(x * sin(2 * pi() * k * t / 128)) AS im FROM s, range(0, 128) r(k) GROUP BY stratum, k) SELECT stratum, k, round(re * re + im * im, 3) AS power FROM p")
def order_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Power of the monthly order counts by frequency, for each priority."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1992 * 12 - 1
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum"), month.cast("long").alias("t")).agg(F.count("*").cast("double").alias("x"))
    return linalg.power_spectrum(s, 128).withColumn("power", F.round("power", 3))


@R.add("SELECT round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS energy, count(*) AS n FROM embeddings")
def singular_energy(spark: SparkSession, d: str) -> DataFrame:
    """The squares of all singular values of the embeddings add up to the squares of all entries."""
    p = points(spark, d)
    s, _ = linalg.thin_svd(p, 10**6)
    return p.agg(F.round(F.lit(float((s**2).sum())), 6).alias("energy"), F.count("*").alias("n"))


@R.add("SELECT CAST(i AS INT) AS component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm FROM range(0, 8) r(i)")
def principal_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is left of C v - value v for the first principal directions, over the value, and their lengths."""
    from ..operators.monitor import covariance

    p = points(spark, d)
    fit = linalg.pca(p, 8)
    c = linalg.dense(covariance(p).select("i", "j", F.col("cov").alias("v")))
    v, w = fit["directions"], fit["values"]
    left = np.linalg.norm(c @ v - v * w, axis=0) / w
    rows = [(k, round(float(left[k]), 6) + 0.0, round(float(np.linalg.norm(v[:, k])), 9)) for k in range(8)]
    return spark.createDataFrame(rows, "component int, residual double, norm double")


@R.add("WITH x AS (SELECT [1.0::DOUBLE, l_discount::DOUBLE] AS a, [1.0::DOUBLE, l_tax::DOUBLE, l_quantity::DOUBLE] AS b FROM lineitem), f AS (SELECT [a[1] * b[1], a[1] * b[2], a[1] * b[3], a[2] * b[1], a[2] * b[2], a[2] * b[3]] AS v FROM x) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(v[i + 1] * v[j + 1]), 4) AS v FROM f, range(0, 6) p(i), range(0, 6) q(j) GROUP BY i, j")
def tensor_gram(spark: SparkSession, d: str) -> DataFrame:
    """The Gram matrix of a tensor basis in discount and in tax and quantity."""
    t = table(spark, d, "lineitem").select(F.array(F.lit(1.0), F.col("l_discount").cast("double")).alias("a"), F.array(F.lit(1.0), F.col("l_tax").cast("double"), F.col("l_quantity").cast("double")).alias("b"))
    return linalg.face_splitting(t, "a", "b").select("i", "j", F.round("v", 4).alias("v"))
