"""Queries over events and orders: ranks, monitors, moments and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions, information
from ..functions.tables import saved
from ..operators import conformal, monitor, sampling
from . import Registry, table
from .graph import points

R = Registry()

_S = "s AS (SELECT event_type AS stratum, event_id AS seq, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)"
_RANK = f"{_S}, k AS (SELECT a.stratum, a.seq, a.score, a.n, count(CASE WHEN b.score < a.score THEN 1 END) AS below, count(CASE WHEN b.score = a.score THEN 1 END) AS tied FROM s a JOIN s b ON a.stratum = b.stratum AND b.seq <= a.seq GROUP BY ALL)"


def stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("stratum"), F.col("event_id").alias("seq"), F.col("value").alias("score"))


@R.add(f"WITH {_RANK} SELECT stratum, seq, n, below, tied, round((below + tied) / n, 9) AS p FROM k")
def smoothed_pvalue_counts(spark: SparkSession, d: str) -> DataFrame:
    return monitor.smoothed_p_values(monitor.running_rank(stream(spark, d))).select("stratum", "seq", "n", "below", "tied", F.round("p", 9).alias("p"))


@R.add(f"WITH {_RANK} SELECT stratum, seq, round(sum(ln(0.5) - 0.5 * ln((below + 0.5 * tied) / n)) OVER (PARTITION BY stratum ORDER BY seq), 6) AS log_capital FROM k")
def power_martingale(spark: SparkSession, d: str) -> DataFrame:
    m = monitor.power_martingale(monitor.smoothed_p_values(monitor.running_rank(stream(spark, d)), 0.5))
    return m.withColumn("log_capital", F.round("log_capital", 6))


@R.add("WITH s AS (SELECT event_type AS stratum, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stratum, n, CAST(max(floor(0.1 * (n + 1))) AS BIGINT) AS k, max(CASE WHEN i = floor(0.1 * (n + 1)) THEN score END) AS threshold FROM s GROUP BY stratum, n")
def split_conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    return monitor.split_conformal(stream(spark, d), 0.1)


@R.add("WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skewness, round(avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3, 6) AS kurtosis FROM events JOIN m USING (event_type) GROUP BY event_type")
def running_moments(spark: SparkSession, d: str) -> DataFrame:
    m = monitor.moments(table(spark, d, "events"), ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "skewness", "kurtosis")])


@R.add("WITH g AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_quantity) AS w2, sum(l_quantity * l_discount) AS wx, sum(l_quantity * l_discount * l_discount) AS wxx FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(wx / w, 9) AS mean, round(wxx / w - (wx / w) * (wx / w), 9) AS variance, round(w * w / w2, 4) AS effective FROM g")
def weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    m = monitor.weighted_moments(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return m.select("l_returnflag", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"), F.round("effective", 4).alias("effective"))


@R.add("WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT i, j, v[i + 1] AS x, v[j + 1] AS y FROM x, range(0, (SELECT max(len(v)) FROM x)) a(i), range(0, (SELECT max(len(v)) FROM x)) b(j)) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(avg(x * y) - avg(x) * avg(y), 9) AS cov FROM p GROUP BY i, j")
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return monitor.covariance(points(spark, d)).withColumn("cov", F.round("cov", 9))


@R.add()
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    values, vectors = monitor.pca(points(spark, d), 5)
    return spark.createDataFrame([(k, float(v), [float(x) for x in vec]) for k, (v, vec) in enumerate(zip(values, vectors, strict=True))], "component int, variance double, direction array<double>")


@R.add("SELECT l_returnflag, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag")
def price_regression(spark: SparkSession, d: str) -> DataFrame:
    r = monitor.linear_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", "n", F.round(F.col("coefficients")[0], 4).alias("intercept"), F.round(F.col("coefficients")[1], 4).alias("slope"))


@R.add("WITH h AS (SELECT user_id % 4 AS chain, event_type AS name, value, row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id % 4, event_type) AS n FROM events), c AS (SELECT name, chain, i > n // 2 AS half, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM h WHERE i <= 2 * (n // 2) GROUP BY ALL), g AS (SELECT name, avg(n) AS n, avg(v) AS within, var_samp(m) AS b FROM c GROUP BY name) SELECT name, round(sqrt((n - 1) / n + b / within), 6) AS r_hat FROM g")
def split_r_hat(spark: SparkSession, d: str) -> DataFrame:
    draws = table(spark, d, "events").select((F.col("user_id") % 4).alias("chain"), F.col("event_id").alias("draw"), F.col("event_type").alias("name"), "value")
    return monitor.split_r_hat(draws).withColumn("r_hat", F.round("r_hat", 6))


@R.add("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * ln(p)), 9) + 0.0 AS entropy FROM p GROUP BY user_id")
def event_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of each user's event types."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").count()
    p = c.groupBy("user_id").agg(F.collect_list(F.col("count").cast("double")).alias("p"))
    return p.select("user_id", (F.round(information.shannon(F.col("p")), 9) + 0.0).alias("entropy"))


@R.add("WITH c AS (SELECT n_nationkey AS k, coalesce(n, 0) AS n, seg FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey AND c_mktsegment = seg), p AS (SELECT k, seg, n / sum(n) OVER (PARTITION BY seg) AS p FROM c), j AS (SELECT a.seg AS first, b.seg AS second, a.p AS p, b.p AS q, (a.p + b.p) / 2 AS m FROM p a JOIN p b ON a.k = b.k AND a.seg < b.seg) SELECT first, second, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2)), 6) AS distance FROM j GROUP BY ALL")
def segment_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon distances between the market segments' distributions over nations."""
    nations, c = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "customer")
    segments = c.select(F.col("c_mktsegment").alias("seg")).distinct()
    n = c.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").cast("double").alias("n"))
    full = nations.join(segments).join(n, ["k", "seg"], "left").na.fill(0.0, ["n"])  # nations by segments: both fixed
    p = full.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"]).alias("p")).select("seg", information.normalised(F.col("p")).alias("p"))
    j = p.select(F.col("seg").alias("first"), "p").join(p.select(F.col("seg").alias("second"), F.col("p").alias("q")), F.col("first") < F.col("second"))
    return j.select("first", "second", F.round(information.jensen_shannon(F.col("p"), F.col("q")), 6).alias("distance"))


@R.add("WITH RECURSIVE o AS (SELECT o_orderpriority AS stratum, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS seq, avg(CAST(o_totalprice AS DOUBLE)) AS v FROM orders GROUP BY ALL), x AS (SELECT stratum, seq, v, row_number() OVER w AS i, sum(v) OVER w AS s, sum(v * v) OVER w AS q, count(*) OVER (PARTITION BY stratum) AS n FROM o WINDOW w AS (PARTITION BY stratum ORDER BY seq)), a AS (SELECT stratum, max(n) AS n, list(v ORDER BY i) AS v, list(seq ORDER BY i) AS seq, [0.0::DOUBLE] || list(s ORDER BY i) AS s, [0.0::DOUBLE] || list(q ORDER BY i) AS q FROM x GROUP BY stratum), dp AS (SELECT stratum, 0 AS t, [-2e8::DOUBLE] AS best, [0::BIGINT] AS back FROM a UNION ALL SELECT stratum, t + 1, best || [list_min(c) + 2e8], back || [list_position(c, list_min(c)) - 1] FROM (SELECT dp.stratum, t, best, back, list_transform(range(0, t + 1), lambda k: best[k + 1] + q[t + 2] - q[k + 1] - pow(s[t + 2] - s[k + 1], 2) / (t + 1 - k)) AS c FROM dp JOIN a ON a.stratum = dp.stratum WHERE t < n)), walk AS (SELECT dp.stratum, CAST(n AS BIGINT) AS t, back[n + 1] AS b, back FROM dp JOIN a ON a.stratum = dp.stratum AND dp.t = a.n UNION ALL SELECT stratum, b, back[b + 1], back FROM walk WHERE b > 0) SELECT walk.stratum, seq[b + 1] AS first, seq[t] AS last, round((s[t + 1] - s[b + 1]) / (t - b), 4) AS mean, t - b AS n FROM walk JOIN a ON a.stratum = walk.stratum")
def order_changepoints(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the monthly mean order value, by priority."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("seq")).agg(F.avg("o_totalprice").alias("value"))
    return sampling.changepoints(o, 2e8).withColumn("mean", F.round("mean", 4))


@R.add()
def order_process(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian process over the same series, with leave-one-out predictions."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("seq")).agg((F.avg("o_totalprice") / 1e5).alias("y"))
    return sampling.gaussian_process(o.withColumn("x", F.col("seq").cast("double")), 6.0, 0.1)


@R.add("WITH m AS (SELECT event_type, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY event_type), z AS (SELECT event_id, event_type, (value - m) / sqrt(v) AS z FROM events JOIN m USING (event_type)) SELECT event_id, event_type, round(z, 9) AS z, round(0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * CASE WHEN z = 0 THEN 0 ELSE list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2.0 * k + 2) + k * ln(2) + CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1.0) END))) END, 6) AS below FROM z")
def normal_tails(spark: SparkSession, d: str) -> DataFrame:
    """Each event's value under the normal law of its type."""
    e = table(spark, d, "events")
    m = monitor.moments(e, ["event_type"], "value").select("event_type", "mean", "variance")
    z = e.join(m, "event_type").select("event_id", "event_type", ((F.col("value") - F.col("mean")) / F.sqrt("variance")).alias("z"))
    return z.select("event_id", "event_type", F.round("z", 9).alias("z"), F.round(distributions.Normal().below_column(F.col("z")), 6).alias("below"))


# Half of the users calibrate, the other half are cases; every event is one or the other.
_HALF = "s AS (SELECT event_type AS stratum, event_id AS seq, value AS score, user_id, 1.0::DOUBLE + user_id % 3 AS weight FROM events), cal AS (SELECT * FROM s WHERE user_id % 2 = 0), cas AS (SELECT * FROM s WHERE user_id % 2 = 1)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("event_type").alias("stratum"), F.col("event_id").alias("seq"), F.col("value").alias("score"), (1.0 + F.col("user_id") % 3).alias("weight"), "user_id")
    return e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 1").drop("user_id").withColumnRenamed("seq", "case")


@R.add(f"WITH {_HALF}, c AS (SELECT stratum, score, sum(weight) OVER (PARTITION BY stratum ORDER BY score, seq) AS w, sum(weight) OVER (PARTITION BY stratum) AS total FROM cal), t AS (SELECT DISTINCT stratum, total FROM c), k AS (SELECT cas.stratum, seq, weight, 0.1::DOUBLE * total - 0.9::DOUBLE * weight AS key FROM cas JOIN t USING (stratum)) SELECT stratum, seq AS \"case\", weight, CASE WHEN key < 0 THEN '-Infinity'::DOUBLE ELSE (SELECT coalesce(min(score), 'Infinity'::DOUBLE) FROM c WHERE c.stratum = k.stratum AND c.w > k.key) END AS threshold FROM k")
def weighted_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Each case's threshold under weights, as covariate shift asks for."""
    calibration, cases = _halves(spark, d)
    return conformal.weighted_thresholds(calibration, cases.select("stratum", "case", "weight"), 0.1)


@R.add(f"WITH {_HALF}, t AS (SELECT stratum, sum(weight) AS total FROM cal GROUP BY stratum) SELECT cas.stratum, cas.seq AS \"case\", cas.score, round((coalesce((SELECT sum(weight) FROM cal WHERE cal.stratum = cas.stratum AND cal.score <= cas.score), 0) + weight) / (total + weight), 9) AS p FROM cas JOIN t USING (stratum)")
def weighted_p_values(spark: SparkSession, d: str) -> DataFrame:
    calibration, cases = _halves(spark, d)
    return conformal.weighted_p_values(calibration, cases).withColumn("p", F.round("p", 9))


@R.add(f"WITH {_HALF}, n AS (SELECT stratum, count(*) AS n FROM cal GROUP BY stratum), k AS (SELECT cas.stratum, cas.seq, n, (SELECT count(*) FROM cal WHERE cal.stratum = cas.stratum AND cal.score < cas.score) AS below, (SELECT count(*) FROM cal WHERE cal.stratum = cas.stratum AND cal.score <= cas.score) AS upto FROM cas JOIN n USING (stratum)) SELECT stratum, seq AS \"case\", round(below / (n + 1), 9) AS lower, round((upto + 1) / (n + 1), 9) AS upper, round((below / (n + 1) + (upto + 1) / (n + 1)) / 2, 9) AS mid FROM k")
def predictive_cdf(spark: SparkSession, d: str) -> DataFrame:
    """A split predictive law's bounds at every case."""
    calibration, cases = _halves(spark, d)
    p = conformal.predictive_cdf(calibration.withColumnRenamed("score", "residual"), cases.withColumnRenamed("score", "residual"))
    return p.select("stratum", "case", *[F.round(c, 9).alias(c) for c in ("lower", "upper", "mid")])


@R.add(f"WITH {_HALF}, a AS (SELECT stratum, seq, 1 - exp(-score / 100) AS pit FROM cal), b AS (SELECT stratum, seq, 1 - exp(-score / 100) AS pit FROM cas), n AS (SELECT stratum, count(*) AS n FROM a GROUP BY stratum) SELECT b.stratum, seq AS \"case\", round(pit, 9) AS pit, round(((SELECT count(*) FROM a WHERE a.stratum = b.stratum AND a.pit < b.pit) + (SELECT count(*) FROM a WHERE a.stratum = b.stratum AND a.pit <= b.pit) + 1) / (2.0 * (n + 1)), 6) AS calibrated FROM b JOIN n USING (stratum)")
def pit_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Transforms under an exponential law, corrected by the calibration half's."""
    calibration, cases = _halves(spark, d)
    pit = 1 - F.exp(-F.col("score") / 100)
    p = conformal.pit_calibration(calibration.withColumn("pit", pit), cases.withColumn("pit", pit))
    return p.select("stratum", "case", F.round("pit", 9).alias("pit"), F.round("calibrated", 6).alias("calibrated"))


_LAW = "exp(lgamma(k + 3 - 1) - lgamma(3) - CASE WHEN k = 1 THEN 0 ELSE lgamma(k) END + lgamma(n + 5 - k - 3 + 2) - lgamma(3) - CASE WHEN n - k + 2 = 1 THEN 0 ELSE lgamma(n - k + 2) END - lgamma(n + 6) + lgamma(6) + lgamma(n + 1))"


@R.add(f"WITH s AS (SELECT event_type AS stratum, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), u AS (SELECT stratum, max(n) AS n FROM s GROUP BY stratum), l AS (SELECT stratum, n, k, {_LAW} AS p FROM (SELECT stratum, n, unnest(range(1, n + 2)) AS k FROM u)), c AS (SELECT *, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS c FROM l), r AS (SELECT stratum, n, coalesce(max(CASE WHEN c <= 0.05 + 1e-12 THEN k END), 0) + 1 AS lo, min(CASE WHEN 1 - c <= 0.05 + 1e-12 THEN k END) AS hi FROM c GROUP BY stratum, n) SELECT r.stratum, r.n, lo AS lower_rank, hi AS upper_rank, a.score AS lower, b.score AS upper, round((SELECT sum(p) FROM l WHERE l.stratum = r.stratum AND k BETWEEN lo AND hi), 6) AS coverage FROM r LEFT JOIN s a ON a.stratum = r.stratum AND a.i = lo - 1 LEFT JOIN s b ON b.stratum = r.stratum AND b.i = hi")
def batch_median(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on the median score of five future events of each type."""
    return conformal.batch_quantile(stream(spark, d), 5, 3, 0.05, 0.05).withColumn("coverage", F.round("coverage", 6))


@R.add("WITH o AS (SELECT o_orderpriority AS stratum, o_orderkey AS seq, o_totalprice - 60000 AS lo, 220000 - o_totalprice AS hi FROM orders), a AS (SELECT stratum, lo, hi, row_number() OVER (PARTITION BY stratum ORDER BY lo, seq) AS i, row_number() OVER (PARTITION BY stratum ORDER BY hi, seq) AS j, count(*) OVER (PARTITION BY stratum) AS n FROM o) SELECT stratum, n, CAST(floor(0.05 * (n + 1)) AS BIGINT) AS k, round(-max(CASE WHEN i = floor(0.05 * (n + 1)) THEN lo END), 4) AS below, round(-max(CASE WHEN j = floor(0.05 * (n + 1)) THEN hi END), 4) AS above FROM a GROUP BY stratum, n")
def quantile_margins(spark: SparkSession, d: str) -> DataFrame:
    """What a constant band from 60,000 to 220,000 must be moved by at either end to hold nine of ten orders."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("seq"), F.lit(60000.0).alias("low"), F.lit(220000.0).alias("high"), F.col("o_totalprice").cast("double").alias("actual"))
    m = conformal.asymmetric_intervals(o, 0.1)
    return m.select("stratum", "n", "k", F.round("below", 4).alias("below"), F.round("above", 4).alias("above"))


@R.add("WITH g AS (SELECT l_returnflag AS stratum, l_orderkey AS seq, min(l_quantity) AS score FROM lineitem GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score, seq) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM g) SELECT stratum, n, CAST(floor(0.1 * (n + 1)) AS BIGINT) AS k, CAST(max(CASE WHEN i = floor(0.1 * (n + 1)) THEN score END) AS DOUBLE) AS threshold FROM i GROUP BY stratum, n")
def group_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Orders as units: the least quantity of each one's lines is its score."""
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stratum"), F.col("l_orderkey").alias("unit"), F.col("l_quantity").cast("double").alias("score"))
    return conformal.group_threshold(t, 0.1)


@R.add("WITH m AS (SELECT * FROM (VALUES (0, 50.0, -1.0), (1, 100.0, 0.0), (2, 200.0, -0.5)) t(model, sd, lw)), w AS (SELECT model, sd, exp(lw) / sum(exp(lw)) OVER () AS share FROM m) SELECT event_type AS stratum, event_id AS seq, round(ln(sum(share * exp(-pow((value - 100) / sd, 2) / 2) / sd)), 6) AS score FROM events, w GROUP BY event_type, event_id")
def averaged_density(spark: SparkSession, d: str) -> DataFrame:
    """Every event's log density under an average of three normal laws (up to a constant)."""
    e = stream(spark, d)
    models = spark.createDataFrame([(0, 50.0, -1.0), (1, 100.0, 0.0), (2, 200.0, -0.5)], "model int, sd double, log_weight double")
    rows = e.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(s).alias("sd")) for k, s in ((0, 50.0), (1, 100.0), (2, 200.0))])))
    den = rows.select("stratum", "seq", "m.model", (-F.pow((F.col("score") - 100) / F.col("m.sd"), F.lit(2)) / 2 - F.log("m.sd")).alias("log_density"))
    return conformal.averaged_scores(den, models.select("model", "log_weight")).withColumn("score", F.round("score", 6))


@R.add("WITH d AS (SELECT l_returnflag, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), g AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) AS vx FROM d GROUP BY l_returnflag) SELECT l_orderkey, l_linenumber, round((y - my - b * (x - mx)) / (1 - 1 / n - pow(x - mx, 2) / (n * vx)), 2) AS loo FROM d JOIN g USING (l_returnflag)")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each line's price less what the other lines of its flag say."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return conformal.leave_one_out(t, ["l_returnflag"], "x", "y").select("l_orderkey", "l_linenumber", F.round("loo", 2).alias("loo"))


@R.add("WITH g AS (SELECT unnest(range(1, 31)) AS grid), r AS (SELECT grid, count(*) AS n, (sum(CASE WHEN value > 25 * grid THEN 1 ELSE 0 END) + 1.0) / (count(*) + 1) AS reading FROM events, g GROUP BY grid) SELECT grid, n, round(reading, 9) AS reading, grid = (SELECT min(grid) FROM r WHERE reading <= 0.1) AS chosen FROM r")
def risk_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The first of thirty limits that loses at most a tenth of events."""
    e = table(spark, d, "events").select(F.col("event_id").alias("unit"), "value", F.explode(F.sequence(F.lit(1), F.lit(30)).cast("array<bigint>")).alias("grid"))
    losses = e.select("grid", "unit", F.when(F.col("value") > 25 * F.col("grid"), 1.0).otherwise(0.0).alias("loss"))
    return conformal.risk_threshold(losses, 0.1).withColumn("reading", F.round("reading", 9))


@R.add("WITH o AS (SELECT o_orderkey % 5 AS fold, CAST(o_totalprice AS DOUBLE) AS y FROM orders), f AS (SELECT fold, (SELECT avg(y) FROM o WHERE o.fold <> u.fold) AS m FROM (SELECT DISTINCT fold FROM o) u), r AS (SELECT fold, abs(y - m) AS r, m FROM o JOIN f USING (fold)), n AS (SELECT count(*) AS n, CAST(floor(0.1 * (count(*) + 1)) AS BIGINT) AS k FROM o), v AS (SELECT r_regionkey, m + 1000 * r_regionkey - r AS lo, m + 1000 * r_regionkey + r AS hi FROM r, region), i AS (SELECT r_regionkey, lo, hi, row_number() OVER (PARTITION BY r_regionkey ORDER BY lo) AS i, row_number() OVER (PARTITION BY r_regionkey ORDER BY hi DESC) AS j FROM v) SELECT CAST(r_regionkey AS BIGINT) AS \"case\", n, k, round(max(CASE WHEN i = k THEN lo END), 3) AS lower, round(max(CASE WHEN j = k THEN hi END), 3) AS upper FROM i, n GROUP BY r_regionkey, n, k")
def cross_intervals(spark: SparkSession, d: str) -> DataFrame:
    """CV+ intervals from five folds of orders; a region's prediction is the other folds' mean and its key."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("fold"), F.col("o_totalprice").cast("double").alias("y"))
    s = o.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    means = s.select("fold", ((F.sum("s").over(Window.partitionBy(F.lit(0))) - F.col("s")) / (F.sum("n").over(Window.partitionBy(F.lit(0))) - F.col("n"))).alias("m"))  # five rows
    means = saved(means, "folds")
    residuals = o.join(F.broadcast(means), "fold").select("fold", (F.col("y") - F.col("m")).alias("residual"))
    shift = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("case"))
    predictions = means.select("fold", "m", F.explode(F.array(*[F.lit(r[0]).cast("long") for r in shift.collect()])).alias("case")).select("case", "fold", (F.col("m") + 1000 * F.col("case")).alias("prediction"))
    c = conformal.cv_plus(residuals, predictions, 0.1)
    return c.select("case", "n", "k", F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))
