"""Mapper with lenses, product covers, clusterers and reports; its frames over a parameter.

A lens is a table (id, value) or (id, values array). A clusterer labels the rows of one
cell of the cover (-1 is dropped): cells are groups of a task each, so the cover has to
be as fine as the data are many.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved
from .cluster import _prim, condense, merge_tree
from .graph import bfs_shells, components, degrees, roots
from .linalg import pca
from .neighbours import knn
from .topology import nerve, uniform_cover

# Lenses

def coordinate(points: DataFrame, k: int = 0) -> DataFrame:
    return points.select("id", F.col("features")[k].alias("value"))


def norm(points: DataFrame) -> DataFrame:
    return points.select("id", F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("value"))


def first_component(points: DataFrame) -> DataFrame:
    return pca(points, 1)["table"].select("id", F.col("features")[0].alias("value"))


def poincare_radius(points: DataFrame) -> DataFrame:
    """Distance from the centre of the ball."""
    r = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    return points.select("id", (2 * F.atanh(F.least(r, F.lit(1 - 1e-15)))).alias("value"))


def local_density(points: DataFrame, k: int = 10, metric: str = "poincare") -> DataFrame:
    """One over the mean distance of the k nearest neighbours."""
    return knn(points, k, metric).groupBy(F.col("src").alias("id")).agg((1 / F.greatest(F.avg("d"), F.lit(1e-12))).alias("value"))


def degree(edges: DataFrame, nodes: DataFrame, weight: str | None = None) -> DataFrame:
    d = degrees(edges, nodes, weight)
    return d.select("id", F.col("weighted" if weight else "degree").cast("double").alias("value"))


def hops(edges: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """Breadth-first distance from a node; unreached nodes are left out."""
    s = bfs_shells(edges, seed)
    s = s.where(F.col("depth") <= most) if most is not None else s
    return s.select("id", F.col("depth").cast("double").alias("value"))


def fiedler(edges: DataFrame, nodes: DataFrame, most: int = 5_000, weight: str = "w") -> DataFrame:
    """Each node's entry of the second eigenvector of the Laplacian, by blocks of iterates; the largest entry is positive.

    The graph travels to the driver, so more than ``most`` nodes are refused.
    """
    from ..functions.linalg import lobpcg

    ids = np.array(sorted(r[0] for r in nodes.select("id").limit(most + 1).collect()))
    if len(ids) > most:
        raise ValueError(f"more than {most} nodes")
    e = edges.select("src", "dst", weight).toPandas()
    a, b, w = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"]), e[weight].to_numpy(float)
    deg = np.bincount(a, w, len(ids)) + np.bincount(b, w, len(ids))

    def apply(x: np.ndarray) -> np.ndarray:
        y = deg[:, None] * x
        np.add.at(y, a, -w[:, None] * x[b])
        np.add.at(y, b, -w[:, None] * x[a])
        return y

    one = np.full((len(ids), 1), 1 / math.sqrt(len(ids)))
    _, v, _ = lobpcg(apply, len(ids), 1, constraints=one, precondition=lambda r: r / np.maximum(deg, 1e-12)[:, None], rounds=1000, tolerance=1e-8)
    return edges.sparkSession.createDataFrame([(int(i), float(x)) for i, x in zip(ids, v[:, 0], strict=True)], "id long, value double")


def product_cover(lenses: list[DataFrame], bins: int, overlap: float) -> DataFrame:
    """(id, bin) over several lenses: a cell for each combination of bins that holds a point, numbered in order of the first lens, then the next."""
    out = None
    for lens in lenses:
        own = uniform_cover(lens, bins, overlap).select("id", F.col("bin").cast("long").alias("b"))
        out = own.withColumnRenamed("b", "bin") if out is None else out.join(own, "id").select("id", (F.col("bin") * bins + F.col("b")).alias("bin"))
    return out.withColumn("bin", F.col("bin").cast("int"))


# Clusterers of one cell's rows

Clusterer = Callable[[np.ndarray], np.ndarray]


def by_kmeans(k: int = 0, seed: int = 0, rounds: int = 100) -> Clusterer:
    """k-means from spread-out centres; 0 takes the root of a third of the rows, from 2 to 10."""
    def run(x: np.ndarray) -> np.ndarray:
        n = min(len(x), k or min(10, max(2, round(math.sqrt(len(x) / 3)))))
        rng = np.random.default_rng(seed)
        centres = [x[0]]
        while len(centres) < n:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            if d.sum() == 0:
                break
            centres.append(x[rng.choice(len(x), p=d / d.sum())])
        c = np.array(centres)
        label = np.zeros(len(x), int)
        for _ in range(rounds):
            new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[new == j].mean(0) if (new == j).any() else c[j] for j in range(len(c))])
            if (new == label).all():
                break
            label = new
        return np.unique(label, return_inverse=True)[1]

    return run


def by_density(min_points: int = 5, min_size: int = 5, keep_noise: bool = True) -> Clusterer:
    """The exact density tree of the cell; what it leaves out is one more cluster, if kept."""
    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < max(2, min_size):
            return np.zeros(n, int) if keep_noise else np.full(n, -1)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = np.sort(d + np.where(np.eye(n) > 0, np.inf, 0), 1)[:, min(min_points, n - 1) - 1]
        ids = np.arange(n)
        tree = merge_tree([(w, a, b) for a, b, w in _prim(ids, lambda i, js: np.maximum(d[i, js], np.maximum(core[i], core[js])), lambda i, best: np.maximum(core[i], core) <= best)], ids.tolist())
        label = condense(tree, n, min_size)
        return np.where(label < 0, label.max() + 1, label) if keep_noise else label

    return run


def by_graph(edges: list[tuple[int, int]]) -> Callable[[np.ndarray], np.ndarray]:
    """Components of a graph's part on given nodes."""
    def run(ids: np.ndarray) -> np.ndarray:
        at = {v: k for k, v in enumerate(ids.tolist())}
        inside = [(at[a], at[b]) for a, b in edges if a in at and b in at]
        a, b = (np.array(c, int) for c in zip(*inside, strict=True)) if inside else (np.zeros(0, int),) * 2
        return np.unique(roots(len(ids), a, b), return_inverse=True)[1]

    return run


# Building

def build(points: DataFrame, cover: DataFrame, cluster: Clusterer) -> DataFrame:
    """(id, bin, cluster, node): the points of each cell clustered on their own."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        out = pd.DataFrame({"id": g["id"], "bin": g["bin"], "cluster": cluster(np.stack(g["features"].to_numpy())).astype(np.int32)})
        return out[out["cluster"] >= 0]

    m = points.select("id", "features").join(cover, "id").groupBy("bin").applyInPandas(one, "id long, bin int, cluster int")
    return m.withColumn("node", F.shiftleft(F.col("bin").cast("long"), 32) + F.col("cluster"))


def build_on_graph(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(id, bin, cluster, node): components of the graph inside each cell, as joins over all cells at once."""
    inside = edges.select("src", "dst").join(cover.select(F.col("id").alias("src"), "bin"), "src").join(cover.select(F.col("id").alias("dst"), F.col("bin").alias("other")), "dst").where(F.col("bin") == F.col("other"))
    # a node of the joint graph is a point in a cell
    name = saved(cover.withColumn("key", F.monotonically_increasing_id()), "cells")
    left = name.select(F.col("id").alias("src"), "bin", F.col("key").alias("a"))
    right = name.select(F.col("id").alias("dst"), "bin", F.col("key").alias("b"))
    e = inside.select("src", "dst", "bin").join(left, ["src", "bin"]).join(right, ["dst", "bin"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(e, name.select(F.col("key").alias("id"))).select(F.col("id").alias("key"), "component")
    return name.join(comp, "key").select("id", "bin", F.col("component").alias("cluster"), F.col("component").alias("node"))


def frames(points: DataFrame, lens: DataFrame, overlap: float, clusterer: Callable[[float], Clusterer], values: list[float], bins: int) -> DataFrame:
    """(t, id, node): Mapper at each value of a clusterer's parameter."""
    cover, out = saved(uniform_cover(lens, bins, overlap), "cover"), None
    for t in values:
        one = build(points, cover, clusterer(t)).select(F.lit(float(t)).alias("t"), "id", "node")
        out = one if out is None else out.unionByName(one)
    return saved(out, "frames")


def component_bars(frames_table: DataFrame) -> DataFrame:
    """(birth, death) of the nerve's components over the frames: a component goes on as the one it shares most points with, the elder where two meet."""
    ts = sorted(r[0] for r in frames_table.select("t").distinct().collect())
    alive: DataFrame | None = None
    spark, bars = frames_table.sparkSession, []
    for t in ts:
        own = frames_table.where(F.col("t") == t)
        nodes = own.select(F.col("node").alias("id")).distinct()
        e = nerve(own).select(F.col("u").alias("src"), F.col("v").alias("dst"))
        comp = components(e, nodes).select(F.col("id").alias("node"), "component")
        now = saved(own.join(comp, "node").select("id", "component").distinct(), "now")
        if alive is None:
            alive = saved(now.select("component").distinct().withColumn("birth", F.lit(float(t))).join(now, "component"), "alive")
            continue
        shared = alive.select("id", F.col("component").alias("old"), "birth").join(now, "id").groupBy("old", "birth", "component").agg(F.count("*").alias("n"))
        to = shared.groupBy("old", "birth").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
        elder = saved(to.groupBy("component").agg(F.min(F.struct("birth", "old")).alias("e")), "elder")
        gone = alive.select("component", "birth").distinct().join(elder.select(F.col("e.old").alias("component")), "component", "left_anti")
        bars.append(gone.select("birth", F.lit(float(t)).alias("death")))
        names = now.select("component").distinct().join(elder, "component", "left").select("component", F.coalesce(F.col("e.birth"), F.lit(float(t))).alias("birth"))
        alive = saved(now.join(names, "component"), "alive")
    out = spark.createDataFrame([], "birth double, death double") if alive is None else alive.select("component", "birth").distinct().select("birth", F.lit(math.inf).alias("death"))
    for b in bars:
        out = out.unionByName(b)
    return out


# Reports

def report(nodes: DataFrame, n_points: int) -> DataFrame:
    """One row: nodes, their sizes, the share of points held, components and independent cycles of the nerve."""
    size = nodes.groupBy("node").agg(F.count_distinct("id").alias("n"))
    s = size.agg(F.count("*").alias("nodes"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count(F.when(F.col("n") == 1, 1)).alias("singles"))
    held = nodes.agg((F.count_distinct("id") / F.lit(max(n_points, 1))).alias("coverage"))
    e = saved(nerve(nodes).select(F.col("u").alias("src"), F.col("v").alias("dst")), "nerve")
    comp = components(e, size.select(F.col("node").alias("id"))).agg(F.count_distinct("component").alias("components"))
    j = s.join(F.broadcast(held)).join(F.broadcast(comp)).join(F.broadcast(e.agg(F.count("*").alias("edges"))))  # one row each
    return j.withColumn("cycles", F.col("edges") - F.col("nodes") + F.col("components"))


def warnings(r: dict) -> list[str]:
    """What a report says against a Mapper graph."""
    out = []
    if r["coverage"] < 0.9:
        out.append(f"only {r['coverage']:.0%} of the points are in a node: more overlap, or a clusterer that drops less")
    if r["nodes"] and r["singles"] / r["nodes"] > 0.5:
        out.append("most nodes hold one point: fewer bins, or a coarser clusterer")
    if r["components"] > max(1, r["nodes"] // 2):
        out.append("the nerve falls apart: more overlap")
    if r["nodes"] and r["edges"] > r["nodes"] * (r["nodes"] - 1) / 4:
        out.append("the nerve is almost complete: less overlap")
    return out


def intrinsic_dimension(nodes: DataFrame, points: DataFrame, least: int = 3) -> DataFrame:
    """(node, n, dimension): how many directions a node's points spread over, the square of its variances' sum over the sum of their squares."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["features"].to_numpy())
        w = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
        return pd.DataFrame({"node": g["node"].iloc[:1], "n": [len(g)], "dimension": [float(w.sum() ** 2 / max((w**2).sum(), 1e-300)) if len(g) >= least else 0.0]})

    j = nodes.select("id", "node").distinct().join(points.select("id", "features"), "id")
    return j.groupBy("node").applyInPandas(one, "node long, n long, dimension double")


def colour(nodes: DataFrame, values: DataFrame, value: Column | str) -> DataFrame:
    """(node, mean) of a value over each node's points."""
    return nodes.select("id", "node").distinct().join(values, "id").groupBy("node").agg(F.avg(value).alias("mean"))
