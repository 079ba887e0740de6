"""From points to a weighted graph in five stages, with choices left to the planner.

topology -> filter -> repair -> refinement -> scaling. Every stage is a DataFrame plan;
between stages small aggregates are read, which decide what ``None`` (automatic) means and
are kept as diagnostics.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import saved
from ..operators import graph, neighbours


@dataclass(frozen=True)
class GraphConfig:
    """None leaves a choice to the planner."""

    metric: str = "euclidean"
    k: int | None = 10
    epsilon: float | None = None
    mutual: bool | None = None
    repair: bool | None = None
    path_bound: float | None = None
    kernel: str = "gaussian"
    scale: float = 0.0
    proximity: bool | None = None
    #: Limits of the automatic choices.
    max_skewness: float = 3.0
    min_coverage: float = 0.95
    near_zero: float = 1e-8
    max_near_zero: float = 0.05


@dataclass
class CompiledGraph:
    edges: DataFrame
    directed: DataFrame
    config: GraphConfig
    scale: float
    diagnostics: dict[str, float] = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)


def compile_graph(points: DataFrame, config: GraphConfig | None = None) -> CompiledGraph:
    """Edges (src, dst, d, w, log_w[, lmp]) with what was resolved.

    Automatic: a mutual filter if the in-degrees' skewness is over its limit; repair if the
    largest component covers too little; local mutual proximity if too many couplings
    vanish.
    """
    c = config or GraphConfig()
    if (c.k is None) == (c.epsilon is None):
        raise ValueError("give either k or epsilon")
    log: list[tuple[str, str]] = []
    facts: dict[str, float] = {}
    nodes = points.select("id")

    directed = saved(neighbours.knn(points, c.k, c.metric) if c.k else neighbours.epsilon_ball(points, c.epsilon, c.metric), "directed")
    facts["skewness"] = graph.hubness_report(neighbours.hubness(directed, nodes)).first()["skewness"] or 0.0
    if c.mutual is None:
        c = replace(c, mutual=facts["skewness"] > c.max_skewness)
        log.append(("info", f"mutual filter {'on' if c.mutual else 'off'}: in-degree skewness {facts['skewness']:.3f}"))
    edges = saved((neighbours.mutual_edges if c.mutual else neighbours.union_edges)(directed), "edges")

    facts["coverage"] = graph.connectivity(edges, nodes).first()["coverage"]
    if c.repair is None:
        c = replace(c, repair=facts["coverage"] < c.min_coverage)
        log.append(("warning" if c.repair else "info", f"repair {'on' if c.repair else 'off'}: largest component covers {facts['coverage']:.3f}"))
    bridges = None
    if c.repair:
        edges, bridges = repair(points, edges, c.metric)
        facts["bridges"] = bridges.count()

    if c.path_bound is not None:
        paths = graph.shortest_paths(edges, nodes, bound=c.path_bound).select(F.col("source").alias("src"), F.col("id").alias("dst"), "distance")
        edges = saved(edges.join(paths, ["src", "dst"], "left").select("src", "dst", F.least("d", F.coalesce("distance", "d")).alias("d")), "refined")

    scale = c.scale or neighbours.bandwidth(edges, "d")
    if not scale:
        scale = neighbours.bandwidth(edges, "d", "mean") or 1.0
        log.append(("warning", "the distances' deviation is 0: their mean is the scale"))
    coupled = neighbours.couple(edges, c.kernel, scale)
    own = coupled if bridges is None else coupled.join(bridges.select("src", "dst"), ["src", "dst"], "left_anti")
    facts["near_zero"] = graph.edge_weight_report(own, near_zero=c.near_zero).first()["near_zero"] or 0.0
    if c.proximity is None:
        c = replace(c, proximity=facts["near_zero"] > c.max_near_zero)
        log.append(("info", f"local mutual proximity {'on' if c.proximity else 'off'}: {facts['near_zero']:.3f} of the couplings vanish"))
    if c.proximity:
        coupled = coupled.join(neighbours.local_mutual_proximity(edges), ["src", "dst"])
    return CompiledGraph(saved(coupled, "graph"), directed, c, scale, facts, log)


def repair(points: DataFrame, edges: DataFrame, metric: str = "euclidean", rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(edges with bridges, bridges): in each round every component takes the shortest way out of it.

    The way is searched among all pairs of points in different components, in blocks, of
    which each point keeps its best: exact, and as costly as an exact neighbour search.
    """
    bridges = None
    for _ in range(rounds):
        comp = saved(graph.components(edges, points), "components")
        if comp.agg(F.count_distinct("component")).first()[0] <= 1:
            break
        best = nearest_outside(points, comp, metric)
        way = best.groupBy("component").agg(F.min(F.struct("d", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.d").distinct()
        way = saved(way.groupBy("src", "dst").agg(F.min("d").alias("d")), "bridges")
        # two components may choose each other by the same edge: it counts once
        bridges = way if bridges is None else saved(bridges.unionByName(way), "bridges")
        edges = saved(edges.select("src", "dst", "d").unionByName(way), "edges")
    return edges, bridges if bridges is not None else edges.limit(0).select("src", "dst", "d")


def nearest_outside(points: DataFrame, comp: DataFrame, metric: str, block: int = neighbours.BLOCK) -> DataFrame:
    """(component, src, dst, d): each point's nearest point of another component, with src < dst."""
    import numpy as np
    import pandas as pd

    from ..functions.metrics import numpy_metric

    distance = numpy_metric(metric)
    tagged = points.join(comp, "id").select("id", F.concat(F.array(F.col("component").cast("double")), "features").alias("features"))

    def cell(g: pd.DataFrame) -> pd.DataFrame:
        q, c = g[g["side"] == 0], g[g["side"] == 1]
        empty = pd.DataFrame({"component": [], "src": [], "dst": [], "d": []})
        if not len(q) or not len(c):
            return empty
        x, y = np.stack(q["features"].to_numpy()), np.stack(c["features"].to_numpy())
        d = np.round(distance(x[:, 1:], y[:, 1:]), neighbours.DIGITS)
        d[x[:, :1] == y[:, 0][None]] = np.inf
        order = np.argsort(c["id"].to_numpy(), kind="stable")  # ties by id
        j = order[d[:, order].argmin(1)]
        i = np.flatnonzero(np.isfinite(d[np.arange(len(x)), j]))
        a, b = q["id"].to_numpy()[i], c["id"].to_numpy()[j[i]]
        return pd.DataFrame({"component": x[i, 0].astype(int), "src": np.minimum(a, b), "dst": np.maximum(a, b), "d": d[i, j[i]]})

    return neighbours._cells(tagged, block).groupBy("cell").applyInPandas(cell, "component long, src long, dst long, d double")
