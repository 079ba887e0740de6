"""Products, Gram matrices and spectra of tables: sums over rows, bounded matrices on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import fft, oriented
from .monitor import covariance


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a sparse matrix product: an equi-join on the inner index, sums combined before the shuffle."""
    j = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return j.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(rows: DataFrame, left: str = "features", right: str | None = None) -> DataFrame:
    """(i, j, v): sums of products of two array columns' entries (or of one with itself), a batch at a time."""
    other = right or left

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x, y = (np.array(b.column(k).to_pylist(), float) for k in (0, b.num_columns - 1))
                total = x.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": pa.array(total.ravel())})

    cols = [left] if other == left else [left, other]
    return rows.select(*cols).mapInArrow(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def face_splitting(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(i, j, v): the Gram matrix of the rows' outer products, never built as columns of a table."""
    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = np.stack(p[left].to_numpy()), np.stack(p[right].to_numpy())
                z = (x[:, :, None] * y[:, None]).reshape(len(p), -1)
                yield pd.DataFrame({"features": list(z)})

    return gram(rows.select(left, right).mapInPandas(outer, "features array<double>"))


def dense(cells: DataFrame) -> np.ndarray:
    """(i, j, v) cells of a bounded matrix as an array."""
    r = cells.collect()
    m = np.zeros((max(x["i"] for x in r) + 1, max(x["j"] for x in r) + 1)) if r else np.zeros((0, 0))
    for x in r:
        m[x["i"], x["j"]] = x["v"]
    return m


def thin_svd(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors by column) of all rows, from their Gram matrix; left vectors are :func:`project` over the values."""
    w, v = np.linalg.eigh(dense(gram(points)))
    order = np.argsort(-w)[:k]
    return np.sqrt(np.maximum(w[order], 0)), oriented(v[:, order])


def project(points: DataFrame, directions: np.ndarray, centre: np.ndarray | None = None) -> DataFrame:
    """(id, features): rows' coordinates along columns of ``directions``."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = np.stack(p["features"].to_numpy())
                yield pd.DataFrame({"id": p["id"], "features": list((x - centre if centre is not None else x) @ directions)})

    return points.select("id", "features").mapInPandas(run, "id long, features array<double>")


def pca(points: DataFrame, k: int, whiten: bool = False) -> dict:
    """mean, values (divisor n), share of the variance, directions by column and the projected table; whitened coordinates have unit variance."""
    r = points.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()  # one row a coordinate
    mean = np.array([m for _, m in sorted((x["i"], x["m"]) for x in r)])
    c = dense(covariance(points).select("i", "j", F.col("cov").alias("v")))
    w, v = np.linalg.eigh((c + c.T) / 2)
    order = np.argsort(-w)[:k]
    values, v = np.maximum(w[order], 0), oriented(v[:, order])
    scale = np.divide(1, np.sqrt(values), out=np.zeros_like(values), where=values > 0) if whiten else np.ones_like(values)
    return {"mean": mean, "values": values, "share": values / max(w.sum(), 1e-300), "directions": v, "table": project(points, v * scale, mean)}


def mahalanobis(points: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """(id, distance) of each row from the mean under the table's own covariance."""
    fit = pca(points, 10**6)
    scale = 1 / np.sqrt(fit["values"] + ridge)
    d = project(points, fit["directions"] * scale, fit["mean"])
    return d.select("id", F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("distance"))


def scaled_distance(values: DataFrame, by: list[str], columns: list[str], floor: float = 1e-12) -> DataFrame:
    """``values`` with each row's distance from its group's means, every column scaled by its standard deviation."""
    g = values.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.var_samp(c).alias(f"_v_{c}") for c in columns])
    total = sum(((F.col(c) - F.col(f"_m_{c}")) ** 2 / F.greatest(F.col(f"_v_{c}"), F.lit(floor)) for c in columns), F.lit(0.0))
    return values.join(g, by).withColumn("distance", F.sqrt(total)).drop(*[f"_{k}_{c}" for k in "mv" for c in columns])


def power_spectrum(series: DataFrame, length: int) -> DataFrame:
    """(stratum, k, power) of each stratum's series (stratum, t, x) with t from 0, padded with zeros to ``length``, a power of two; longer series are refused."""
    kind = dict(series.dtypes)["stratum"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) and int(g["t"].max()) >= length:
            raise ValueError(f"a series is longer than {length}")
        x = np.zeros(length)
        x[g["t"].to_numpy(int)] = g["x"].to_numpy(float)
        p = np.abs(fft(x)) ** 2
        return pd.DataFrame({"stratum": g["stratum"].iloc[0], "k": np.arange(length), "power": p})

    return series.groupBy("stratum").applyInPandas(run, f"stratum {kind}, k long, power double")
