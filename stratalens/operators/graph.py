"""Undirected graphs as edge tables (src < dst, one row an edge), and their observables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import saved
from .neighbours import population_skewness, symmetric


def degrees(edges: DataFrame, nodes: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(id, degree[, weighted])."""
    s = symmetric(edges, weight or "dst") if weight else edges.select("src").unionByName(edges.select(F.col("dst").alias("src")))
    aggs = [F.count("*").alias("degree")] + ([F.sum(weight).alias("weighted")] if weight else [])
    d = s.groupBy(F.col("src").alias("id")).agg(*aggs)
    if nodes is None:
        return d
    return nodes.select("id").join(d, "id", "left").na.fill(0)


def degree_histogram(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, nodes).groupBy("degree").agg(F.count("*").alias("nodes"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c.

    Each edge points from the end of smaller (degree, id), so that no node has more than
    about the square root of twice the edges, however large a hub is.
    """
    e = edges.select("src", "dst")
    d = degrees(e).select("id", "degree")
    o = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    low = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = o.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    t = wedge.join(e, (F.col("x") == F.col("src")) & (F.col("y") == F.col("dst")))
    s = F.array_sort(F.array("u", "x", "y"))
    return t.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


#: Up to so many edges, a graph is finished in one task: rounds of jobs would cost more.
SMALL = 200_000


def _is_small(edges: DataFrame, small: int) -> bool:
    return small > 0 and edges.limit(small + 1).count() <= small


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each one's component among 0..n-1: hooking and pointer jumping over whole arrays."""
    r = np.arange(n)
    while len(a):
        lo, hi = np.minimum(r[a], r[b]), np.maximum(r[a], r[b])
        live = lo != hi
        a, b = a[live], b[live]
        np.minimum.at(r, hi[live], lo[live])
        while True:
            jump = r[r]
            if (jump == r).all():
                break
            r = jump
    return r


def _components_of_group(g: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.r_[g["src"], g["dst"]], return_inverse=True)
    r = roots(len(ids), at[: len(g)], at[len(g) :])
    return pd.DataFrame({"id": ids, "v": ids[r]})


def _forest_of_group(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["w", "src", "dst"], kind="stable")
    ids, at = np.unique(np.r_[g["src"], g["dst"]], return_inverse=True)
    root, keep = list(range(len(ids))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, b) in enumerate(zip(at[: len(g)].tolist(), at[len(g) :].tolist(), strict=True)):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(i)
    return g.iloc[keep][["src", "dst", "w"]]


def components(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component): the smallest node each one reaches; isolated nodes are their own.

    Large-star and small-star steps, each a grouped minimum and an equi-join; a graph of
    up to ``small`` edges takes one task instead.
    """
    if _is_small(edges, small):
        own = edges.select("src", "dst").groupBy().applyInPandas(_components_of_group, "id long, v long")
        return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("v", "id").alias("component"))
    e = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = saved(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        done = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if done:
            break
    return nodes.select("id").join(e.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def minimum_spanning_forest(edges: DataFrame, nodes: DataFrame, weight: str = "d", small: int = SMALL) -> DataFrame:
    """(src, dst, weight): Boruvka rounds; ties by (weight, src, dst), so the forest is unique.

    A graph of up to ``small`` edges takes one task instead, with the same result.
    """
    if _is_small(edges, small):
        rows = edges.select("src", "dst", F.col(weight).cast("double").alias("w"))
        return rows.groupBy().applyInPandas(_forest_of_group, "src long, dst long, w double").withColumnRenamed("w", weight)
    label = saved(nodes.select("id", F.col("id").alias("c")), "labels")
    live = saved(edges.select("src", "dst", F.col(weight).alias("w")), "live")
    forest = None
    while True:
        j = live.join(label.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        live = saved(j.select("src", "dst", "w", "cs", "cd"), "live")
        if live.isEmpty():
            break
        best = live.select(F.explode(F.array("cs", "cd")).alias("c"), "src", "dst", "w").groupBy("c").agg(F.min(F.struct("w", "src", "dst")).alias("e"))
        chosen = saved(best.select("e.src", "e.dst", "e.w").distinct(), "chosen")
        forest = chosen if forest is None else saved(forest.unionByName(chosen), "forest")
        merged = components(chosen.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), label.select(F.col("c").alias("id")).distinct(), small)
        label = saved(label.join(merged.select(F.col("id").alias("c"), "component"), "c").select("id", F.col("component").alias("c")), "labels")
        live = live.select("src", "dst", "w")
    empty = edges.limit(0).select("src", "dst", F.col(weight).alias(weight))
    return empty if forest is None else forest.withColumnRenamed("w", weight)


def bfs_shells(edges: DataFrame, seed: int, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what ``seed`` reaches."""
    s = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    spark = edges.sparkSession
    seen = saved(spark.createDataFrame([(seed, 0)], "id long, depth int"), "shells")
    depth = 0
    while max_depth is None or depth < max_depth:
        frontier = s.join(seen.where(F.col("depth") == depth).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = saved(frontier.select("id", F.lit(depth + 1).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen, depth = seen.unionByName(frontier), depth + 1
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "d", bound: float = float("inf")) -> DataFrame:
    """(source, id, distance) up to ``bound``: grouped relaxation until nothing shrinks."""
    s = symmetric(edges, weight)
    best = saved(sources.select(F.col("id").alias("source"), F.col("id"), F.lit(0.0).alias("distance")), "paths")
    moved = best
    while True:
        step = moved.join(s.select(F.col("src").alias("id"), "dst", weight), "id").select("source", F.col("dst").alias("id"), (F.col("distance") + F.col(weight)).alias("distance")).where(F.col("distance") <= F.lit(bound))
        step = step.groupBy("source", "id").agg(F.min("distance").alias("distance"))
        moved = saved(step.join(best.withColumnRenamed("distance", "old"), ["source", "id"], "left").where("old IS NULL OR distance < old").select("source", "id", "distance"), "moved")
        if moved.isEmpty():
            return best
        best = saved(best.unionByName(moved).groupBy("source", "id").agg(F.min("distance").alias("distance")), "paths")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def repair_edges(after: DataFrame, before: DataFrame) -> DataFrame:
    """Edges that a repair added."""
    return after.join(before.select("src", "dst"), ["src", "dst"], "left_anti")


def connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, largest, coverage, isolated, cyclomatic number."""
    c = components(edges, nodes).groupBy("component").agg(F.count("*").alias("size"))
    r = c.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), F.count(F.when(F.col("size") == 1, 1)).alias("isolated"))
    m = edges.agg(F.count("*").alias("edges"))
    return r.join(F.broadcast(m)).select("nodes", "edges", "components", "largest", (F.col("largest") / F.col("nodes")).alias("coverage"), "isolated", (F.col("edges") - F.col("nodes") + F.col("components")).alias("cyclomatic"))


def edge_weight_report(edges: DataFrame, weight: str = "w", near_zero: float = 1e-8) -> DataFrame:
    return edges.agg(F.min(weight).alias("min"), F.percentile(weight, 0.5).alias("median"), F.max(weight).alias("max"), F.avg(F.when(F.col(weight) < near_zero, 1.0).otherwise(0.0)).alias("near_zero"))


def hubness_report(in_degrees: DataFrame) -> DataFrame:
    """Skew of the in-degrees, hubs (over twice the mean), anti-hubs (none)."""
    mean = in_degrees.agg(F.avg("in_degree").alias("mean"))
    j = in_degrees.join(F.broadcast(mean))
    return j.agg(population_skewness(F.col("in_degree")).alias("skewness"), F.count(F.when(F.col("in_degree") > 2 * F.col("mean"), 1)).alias("hubs"), F.count(F.when(F.col("in_degree") == 0, 1)).alias("anti_hubs"))


# Labels on edges

def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels (id, label) of both ends; -1 is unassigned."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    return edges.join(a, "src").join(b, "dst").where("ls >= 0 AND ld >= 0")


def link_overlap(edges: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of edges on which two partitions agree that the ends belong together."""
    e = labelled(edges, first).withColumnRenamed("ls", "a").withColumnRenamed("ld", "b")
    e = labelled(e, second)
    return e.agg(F.avg(F.when((F.col("a") == F.col("b")) == (F.col("ls") == F.col("ld")), 1.0).otherwise(0.0)).alias("overlap"), F.count("*").alias("edges"))


def partition_scores(edges: DataFrame, labels: DataFrame, weight: str = "w") -> DataFrame:
    """modularity, coverage and mean conductance of a partition on a weighted graph."""
    e = labelled(edges, labels)
    within = F.sum(F.when(F.col("ls") == F.col("ld"), F.col(weight)).otherwise(0.0))
    total = e.agg(F.sum(weight).alias("m"), within.alias("inside"))
    ends = e.select(F.explode(F.array(F.struct(F.col("ls").alias("c"), F.col("ld").alias("o")), F.struct(F.col("ld").alias("c"), F.col("ls").alias("o")))).alias("x"), weight).select("x.c", "x.o", weight)
    by = ends.groupBy("c").agg(F.sum(weight).alias("vol"), F.sum(F.when(F.col("c") != F.col("o"), F.col(weight)).otherwise(0.0)).alias("cut"))
    j = by.join(F.broadcast(total))
    rest = F.least(F.col("vol"), 2 * F.col("m") - F.col("vol"))
    g = j.agg(F.max("m").alias("m"), F.max("inside").alias("inside"), F.sum(F.col("vol") ** 2).alias("v2"), F.avg(F.when(rest > 0, F.col("cut") / rest).otherwise(0.0)).alias("conductance"))
    return g.select((F.col("inside") / F.col("m") - F.col("v2") / (4 * F.col("m") ** 2)).alias("modularity"), (F.col("inside") / F.col("m")).alias("coverage"), "conductance")


# Fields and affinities

def local_field(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(src, dst, field) half-edges: couplings of each node in ascending order, summed up to and with each."""
    w = Window.partitionBy("src").orderBy(weight, "dst").rowsBetween(Window.unboundedPreceding, 0)
    return symmetric(edges, weight).withColumn("field", F.sum(weight).over(w))


def affinity(field: Column, temperature: float) -> Column:
    return 1 - F.exp(-field / F.lit(temperature))


def bond_probability(coupling: Column, temperature: float) -> Column:
    """Fortuin-Kasteleyn bonds."""
    return 1 - F.exp(-coupling / F.lit(temperature))


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def affinity_nodes(edges: DataFrame, rate: str) -> DataFrame:
    """(id, degree, entropy): sums of rates and of their binary entropies at each node."""
    return symmetric(edges, rate).groupBy(F.col("src").alias("id")).agg(F.sum(rate).alias("degree"), F.sum(binary_entropy(F.col(rate))).alias("entropy"))
