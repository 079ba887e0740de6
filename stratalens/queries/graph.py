"""Queries over neighbour graphs of the embeddings, and over co-supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import graph, neighbours, spectral
from ..plans.compiler import compile_graph
from . import Registry, table

R = Registry()
K = 5

E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
P = f"{E}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"
KNN = f"{P}, knn AS (SELECT * FROM (SELECT src, dst, d, CAST(rank() OVER (PARTITION BY src ORDER BY d) AS INT) AS rank FROM p) WHERE rank <= {K})"
EDGES = f"{KNN}, edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(d) AS d FROM knn GROUP BY ALL), halves AS (SELECT src, dst, d FROM edges UNION ALL SELECT dst, src, d FROM edges)"
H = f"{EDGES}, h AS (SELECT 1.4826 * quantile_cont(abs(d - m), 0.5) AS h FROM edges, (SELECT quantile_cont(d, 0.5) AS m FROM edges))"
W = f"{EDGES}, h AS (SELECT quantile_cont(d, 0.5) AS h FROM edges), w AS (SELECT src, dst, d, exp(-d * d / (2 * h * h)) AS w FROM edges, h)"
WL = f"{W}, wl AS (SELECT w.*, a.label AS ls, b.label AS ld FROM w JOIN e a ON src = a.vec_id JOIN e b ON dst = b.vec_id WHERE a.label >= 0 AND b.label >= 0)"



def forest_sql(edges: str) -> str:
    """Kruskal's rounds over a table of edges (src, dst, d): ``step`` holds the edge that each one adds, if any."""
    return f"""idx AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i FROM e), es AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, src, dst) AS k, a.i AS si, b.i AS di, src, dst, d FROM {edges} x JOIN idx a ON src = a.id JOIN idx b ON dst = b.id),
step AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list(i ORDER BY i) FROM idx) AS comp, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS DOUBLE) AS d
UNION ALL SELECT k, CASE WHEN a <> b THEN list_transform(comp, lambda c: CASE WHEN c = b THEN a ELSE c END) ELSE comp END, CASE WHEN a <> b THEN src END, CASE WHEN a <> b THEN dst END, CASE WHEN a <> b THEN d END FROM (SELECT es.k, comp, comp[si] AS a, comp[di] AS b, es.src, es.dst, es.d FROM step JOIN es ON es.k = step.k + 1))"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn_graph(points(spark, d), K)


def coupled(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return neighbours.couple(e, scale=neighbours.bandwidth(e, "d", "median"))


@R.add(f"WITH {KNN} SELECT src, dst, d, rank FROM knn")
def euclidean_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(points(spark, d), K)


@R.add(f"WITH {E}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(1 - list_cosine_similarity(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT * FROM (SELECT src, dst, d, CAST(rank() OVER (PARTITION BY src ORDER BY d) AS INT) AS rank FROM p) WHERE rank <= {K}")
def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.knn(points(spark, d), K, "cosine")


@R.add(f"WITH {E} SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))), 9) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE d < 8.5")
def manhattan_ball(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.epsilon_ball(points(spark, d), 8.5, "manhattan")


@R.add(f"WITH {P} SELECT src, dst, d FROM p WHERE d < 1.25")
def eps_ball_edges(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.epsilon_ball(points(spark, d), 1.25)


@R.add(f"WITH {EDGES} SELECT * FROM edges")
def union_knn(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@R.add(f"WITH {KNN} SELECT a.src, a.dst, a.d FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_edges(neighbours.knn(points(spark, d), K))


@R.add(f"WITH {KNN} SELECT vec_id AS id, count(knn.src) AS in_degree FROM e LEFT JOIN knn ON vec_id = dst GROUP BY vec_id")
def hubness(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.hubness(neighbours.knn(points(spark, d), K), points(spark, d))


@R.add(f"WITH {KNN}, n AS (SELECT vec_id, count(knn.src) AS k FROM e LEFT JOIN knn ON vec_id = dst GROUP BY vec_id), m AS (SELECT avg(k) AS m FROM n) SELECT round(avg(pow(k - m, 3)) / pow(avg(pow(k - m, 2)), 1.5), 6) AS skewness, count(CASE WHEN k > 2 * m THEN 1 END) AS hubs, count(CASE WHEN k = 0 THEN 1 END) AS anti_hubs FROM n, m")
def hubness_report(spark: SparkSession, d: str) -> DataFrame:
    r = graph.hubness_report(neighbours.hubness(neighbours.knn(points(spark, d), K), points(spark, d)))
    return r.withColumn("skewness", F.round("skewness", 6))


@R.add(f"WITH {H} SELECT round(h, 9) AS bandwidth FROM h")
def bandwidth_mad(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(neighbours.bandwidth(edges(spark, d), "d"), 9),)], "bandwidth double")


@R.add(f"WITH {W} SELECT src, dst, round(w, 6) AS w FROM w")
def gaussian_coupling(spark: SparkSession, d: str) -> DataFrame:
    return coupled(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


@R.add(f"WITH {EDGES}, s AS (SELECT src, dst, (count(*) OVER (PARTITION BY src) - count(*) OVER (PARTITION BY src ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / count(*) OVER (PARTITION BY src) AS p FROM halves) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(p) * max(p), 9) AS lmp FROM s GROUP BY ALL")
def lmp_weights(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.local_mutual_proximity(edges(spark, d)).withColumn("lmp", F.round("lmp", 9))


@R.add(f"WITH {EDGES} SELECT degree, count(*) AS nodes FROM (SELECT vec_id, count(halves.src) AS degree FROM e LEFT JOIN halves ON vec_id = src GROUP BY vec_id) GROUP BY degree")
def degree_hist(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(edges(spark, d), points(spark, d))


@R.add(f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(edges(spark, d))


@R.add(f"WITH RECURSIVE {EDGES}, r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT halves.dst, r.c FROM r JOIN halves ON halves.src = r.id WHERE r.c < halves.dst) SELECT id, min(c) AS component FROM r GROUP BY id")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(spark, d), points(spark, d))


@R.add(f"WITH RECURSIVE {EDGES}, {forest_sql('edges')} SELECT src, dst, d FROM step WHERE d IS NOT NULL")
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.minimum_spanning_forest(edges(spark, d), points(spark, d))


@R.add(f"WITH RECURSIVE {EDGES}, r(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT halves.dst, r.depth + 1 FROM r JOIN halves ON halves.src = r.id WHERE r.depth < 40) SELECT id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY id")
def bfs_from_zero(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_shells(edges(spark, d), 0)


@R.add(f"WITH {W} SELECT round(min(w), 9) AS min, round(quantile_cont(w, 0.5), 9) AS median, round(max(w), 9) AS max, round(avg(CASE WHEN w < 1e-8 THEN 1.0 ELSE 0 END), 9) AS near_zero FROM w")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    r = graph.edge_weight_report(coupled(spark, d))
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@R.add(f"WITH {WL}, t AS (SELECT sum(w) AS m, sum(CASE WHEN ls = ld THEN w ELSE 0 END) AS inside FROM wl), x AS (SELECT ls AS c, ld AS o, w FROM wl UNION ALL SELECT ld, ls, w FROM wl), b AS (SELECT c, sum(w) AS vol, sum(CASE WHEN c <> o THEN w ELSE 0 END) AS cut FROM x GROUP BY c) SELECT round(any_value(inside / m) - sum(vol * vol) / (4 * any_value(m) * any_value(m)), 6) AS modularity, round(any_value(inside / m), 6) AS coverage, round(avg(CASE WHEN least(vol, 2 * m - vol) > 0 THEN cut / least(vol, 2 * m - vol) ELSE 0 END), 6) AS conductance FROM b, t")
def partition_scores(spark: SparkSession, d: str) -> DataFrame:
    r = graph.partition_scores(coupled(spark, d), labels(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@R.add(f"WITH {W}, s AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w) SELECT src, dst, round(sum(w) OVER (PARTITION BY src ORDER BY w, dst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS field FROM s")
def local_field_ladder(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_field(coupled(spark, d)).select("src", "dst", F.round("field", 6).alias("field"))


@R.add(f"WITH {W}, a AS (SELECT src, dst, 1 - exp(-w / 0.5) AS p FROM w), s AS (SELECT src AS id, p FROM a UNION ALL SELECT dst, p FROM a) SELECT id, round(sum(p), 6) AS degree, round(sum(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END), 6) AS entropy FROM s GROUP BY id")
def affinity_observables(spark: SparkSession, d: str) -> DataFrame:
    e = coupled(spark, d).withColumn("p", graph.bond_probability(F.col("w"), 0.5))
    n = graph.affinity_nodes(e, "p")
    return n.select("id", F.round("degree", 6).alias("degree"), F.round("entropy", 6).alias("entropy"))


@R.add("SELECT a.s AS src, b.s AS dst, count(*) AS parts FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) b ON a.p = b.p AND a.s < b.s GROUP BY ALL")
def co_supply_graph(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share parts: an equi self-join on the shared member."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    j = x.withColumnRenamed("s", "src").join(x.withColumnRenamed("s", "dst"), "p").where("src < dst")
    return j.groupBy("src", "dst").agg(F.count("*").alias("parts"))


_PAIR = "a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT x.vec_id, x.v AS a, y.v AS b FROM a x JOIN a y ON y.vec_id = x.vec_id + 1), z AS (SELECT vec_id, a, b, list_zip(a, b) AS z FROM q)"


@R.add(f"WITH {_PAIR} SELECT vec_id, round(list_distance(a, b), 6) AS euclidean, round(list_sum(list_transform(z, lambda t: abs(t[1] - t[2]))), 6) AS manhattan, round(list_max(list_transform(z, lambda t: abs(t[1] - t[2]))), 6) AS chebyshev, round(list_sum(list_transform(z, lambda t: CASE WHEN abs(t[1]) + abs(t[2]) = 0 THEN 0 ELSE abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2])) END)), 6) AS canberra, round(1 - list_cosine_similarity(a, b), 6) AS cosine, round(acos(greatest(-1, least(1, list_cosine_similarity(a, b)))) / pi(), 6) AS angular, round(pow(list_sum(list_transform(z, lambda t: pow(abs(t[1] - t[2]), 3))), 1.0 / 3), 6) AS minkowski3 FROM z")
def metric_columns(spark: SparkSession, d: str) -> DataFrame:
    """Distances of each embedding to the next one, metric by metric."""
    p = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    j = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    names = {"minkowski3": "minkowski:p=3"} | {n: n for n in ("euclidean", "manhattan", "chebyshev", "canberra", "cosine", "angular")}
    return j.select("vec_id", *[F.round(metrics.metric(m)(F.col("a"), F.col("b")), 6).alias(n) for n, m in names.items()])


@R.add(f"WITH {WL}, a AS (SELECT w.src, w.dst, abs(hash_a - hash_b) AS x FROM (SELECT src, dst, src % 3 AS hash_a, dst % 3 AS hash_b FROM w) w) SELECT round(avg(CASE WHEN (x = 0) = (ls = ld) THEN 1.0 ELSE 0 END), 9) AS overlap, count(*) AS edges FROM wl JOIN a ON wl.src = a.src AND wl.dst = a.dst")
def link_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Agreement on edges of the labels with a partition by id modulo three."""
    thirds = points(spark, d).select("id", (F.col("id") % 3).alias("label"))
    r = graph.link_overlap(coupled(spark, d), labels(spark, d), thirds)
    return r.select(F.round("overlap", 9).alias("overlap"), "edges")


@R.add(f"WITH {EDGES} SELECT (SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT src) FROM halves) AS touched")
def graph_size(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    t = neighbours.symmetric(e).select("src").distinct().count()
    return spark.createDataFrame([(points(spark, d).count(), e.count(), t)], "nodes long, edges long, touched long")


@R.add()
def algebraic_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Of each label's own part of the neighbour graph."""
    e = graph.labelled(coupled(spark, d), labels(spark, d)).where("ls = ld").select(F.col("ls").cast("long").alias("group"), "src", "dst", "w")
    return spectral.algebraic_connectivity(e)


@R.add()
def compiled_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the planner's graph with its automatic choices."""
    return compile_graph(points(spark, d)).edges
