import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import monitor
from stratalens.sources import tables
from stratalens.streaming import monitors


def stream(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("ab"[i % 3 == 0], i, float(rng.integers(0, 40))) for i in range(n)]
    return rows, spark.createDataFrame([*rows, ("a", n, math.nan), ("b", n + 1, None)], "stratum string, seq long, score double")


@pytest.mark.parametrize("chunk", [4096, 16, 1])
def test_running_rank(spark, chunk):
    rows, s = stream(spark, 200)
    got = {r["seq"]: (r["n"], r["below"], r["tied"]) for r in monitor.running_rank(s, chunk).collect()}
    for k, (g, seq, x) in enumerate(rows):
        before = [y for h, q, y in rows if h == g and q <= seq]
        assert got[seq] == (len(before), sum(y < x for y in before), sum(y == x for y in before))
    assert len(got) == len(rows)


def test_p_values_are_uniform_and_capital_stays_low(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.normal(size=2000))], "stratum string, seq long, score double")
    p = monitor.smoothed_p_values(monitor.running_rank(s), 0.5)
    q = np.sort([r["p"] for r in p.collect()])
    assert np.abs(q - (np.arange(2000) + 0.5) / 2000).max() < 0.05
    assert monitor.alarms(monitor.power_martingale(p), 0.001).count() == 0
    drift = spark.createDataFrame([("x", i, float(v + (i > 600) * -4)) for i, v in enumerate(rng.normal(size=900))], "stratum string, seq long, score double")
    a = monitor.alarms(monitor.power_martingale(monitor.smoothed_p_values(monitor.running_rank(drift), 0.5))).first()
    assert 600 < a["seq"] < 750


def test_split_conformal_covers(spark):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.normal(size=999))], "stratum string, seq long, score double")
    r = monitor.split_conformal(s, 0.1).first()
    assert r["k"] == 100 and 0.08 < np.mean(rng.normal(size=20_000) < r["threshold"]) < 0.12
    assert monitor.split_conformal(s.limit(3), 0.1).first()["threshold"] == -math.inf


def test_moments_and_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    d = spark.createDataFrame([("g", *map(float, r), float(1 + 2 * r[0] - r[1])) for r in x], "k string, a double, b double, c double, y double")
    r = monitor.linear_regression(d, ["a", "b", "c"], "y", ["k"]).first()
    assert np.allclose(r["coefficients"], [1, 2, -1, 0], atol=1e-8)
    p = d.select(F.monotonically_increasing_id().alias("id"), F.array("a", "b", "c").alias("features"))
    c = np.zeros((3, 3))
    for q in monitor.covariance(p).collect():
        c[q["i"], q["j"]] = q["cov"]
    assert np.allclose(c, np.cov(x.T, bias=True))
    w, v = monitor.pca(p, 3)
    assert np.allclose(sorted(w), np.linalg.eigvalsh(c)) and np.allclose(v @ v.T, np.eye(3))
    m = monitor.moments(spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 9.0), ("h", 5.0)], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert round(m[0]["skewness"], 3) == 0.665 and m[1]["skewness"] == 0


def test_chain_diagnostics(spark):
    rng = np.random.default_rng(4)
    rows = [(c, i, "x", float(v)) for c in range(3) for i, v in enumerate(rng.normal(size=300))]
    rows += [(c, i, "y", float(v + 5 * c)) for c in range(3) for i, v in enumerate(rng.normal(size=300))]
    d = spark.createDataFrame(rows, "chain int, draw long, name string, value double")
    r = {x["name"]: x["r_hat"] for x in monitor.split_r_hat(d).collect()}
    assert r["x"] < 1.05 < 2 < r["y"]
    assert all(x["ess"] > 150 for x in monitor.autocovariance_ess(d, 20).where("name = 'x'").collect())


def test_streams(spark, tmp_path):
    rows, s = stream(spark, 120)
    s = s.where("score IS NOT NULL AND NOT isnan(score)")
    src = str(tmp_path / "in")
    s.repartition(1).write.parquet(src)
    live = spark.readStream.schema(s.schema).parquet(src)
    for name, df in (("m", monitors.running_moments(live)), ("c", monitors.martingale(live, 0, 40))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    m = {r["stratum"]: r for r in spark.table("m").collect()}
    for g in "ab":
        x = [v for h, _, v in rows if h == g]
        assert m[g]["n"] == len(x) and math.isclose(m[g]["mean"], np.mean(x)) and math.isclose(m[g]["variance"], np.var(x))
    assert spark.table("c").count() == len(rows) and spark.table("c").where("p <= 0 OR p > 1").count() == 0


def test_points_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,name\n# note\n1,2,B\n\n3.5,4,a\n")
    got = tables.read_points(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert [(r["features"], r["label"]) for r in got] == [([1.0, 2.0], 1), ([3.5, 4.0], 0)]
    (tmp_path / "q.csv").write_text("7,1\n8,2\n")
    assert [r["label"] for r in tables.read_points(spark, str(tmp_path / "q.csv"), label=0, header=False).orderBy("id").collect()] == [7, 8]
    (tmp_path / "bad.csv").write_text("x,l\noops,1\n")
    with pytest.raises(Exception):
        tables.read_points(spark, str(tmp_path / "bad.csv")).collect()


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_write(spark, tmp_path, form):
    d = spark.createDataFrame([(1, 'a "quoted", text', [1.0, 2.0]), (2, None, None)], "id long, s string, v array<double>")
    path = tables.write_table(d, str(tmp_path / form), form)
    back = getattr(spark.read.option("header", True).option("quote", '"').option("escape", '"'), form)(path)
    assert back.count() == 2 and set(back.columns) == {"id", "s", "v"}
    with pytest.raises(Exception):
        tables.write_table(d, path, form)
    assert tables.artifact_path("/x/", "spc", "s", "a.csv") == "/x/spc/s/a.csv" and len(tables.run_stamp()) == 15
