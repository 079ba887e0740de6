import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import metrics
from stratalens.operators import cluster, evaluate, graph, neighbours, topology
from stratalens.sources import synthetic


def cloud(spark, n=60, d=3, seed=0):
    x = np.round(np.random.default_rng(seed).normal(size=(n, d)), 2)
    x[5] = x[9]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "chebyshev", "cosine", "minkowski:p=3"])
def test_metrics_agree(spark, name):
    x, p = cloud(spark, 12)
    j = p.join(p.select(F.col("id").alias("o"), F.col("features").alias("g"))).select("id", "o", metrics.metric(name)(F.col("features"), F.col("g")).alias("d"))
    m = metrics.numpy_metric(name)(x, x)
    assert all(math.isclose(r["d"], m[r["id"], r["o"]], abs_tol=1e-7) for r in j.collect())


@pytest.mark.parametrize("block", [2048, 17])
def test_knn_keeps_ties(spark, block):
    x, p = cloud(spark)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and d[i, j] <= np.sort(d[i])[3]}
    assert {(r["src"], r["dst"]) for r in neighbours.knn(p, 4, block=block).collect()} == want
    ball = {(i, j) for i, j in itertools.permutations(range(len(x)), 2) if d[i, j] < 0.8}
    assert {(r["src"], r["dst"]) for r in neighbours.epsilon_ball(p, 0.8, block=block).collect()} == ball


def test_edges_of_both_rules(spark):
    k = spark.createDataFrame([(0, 1, 1.0, 1), (1, 0, 1.0, 1), (1, 2, 2.0, 2)], "src long, dst long, d double, rank int")
    assert {tuple(r) for r in neighbours.union_edges(k).collect()} == {(0, 1, 1.0), (1, 2, 2.0)}
    assert {tuple(r) for r in neighbours.mutual_edges(k).collect()} == {(0, 1, 1.0)}


def random_graph(spark, n=40, m=70, seed=1):
    rng = np.random.default_rng(seed)
    e = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)}
    rows = [(a, b, float(np.round(rng.random(), 3))) for a, b in sorted(e)]
    return rows, spark.createDataFrame(rows, "src long, dst long, d double"), spark.range(n)


def roots(n, edges):
    r = list(range(n))

    def find(x):
        while r[x] != x:
            x = r[x]
        return x

    for a, b, *_ in edges:
        p, q = find(a), find(b)
        r[max(p, q)] = min(p, q)
    return {x: find(x) for x in range(n)}


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_components_and_forest(spark, small):
    rows, e, nodes = random_graph(spark)
    assert {r["id"]: r["component"] for r in graph.components(e, nodes, small).collect()} == roots(40, rows)
    kruskal = []
    for a, b, w in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        r = roots(40, kruskal)
        if r[a] != r[b]:
            kruskal.append((a, b, w))
    assert {tuple(r) for r in graph.minimum_spanning_forest(e, nodes, small=small).collect()} == set(kruskal)
    assert graph.minimum_spanning_forest(e.limit(0), nodes, small=small).count() == 0


def test_graph_algorithms(spark):
    rows, e, nodes = random_graph(spark)
    tri = {t for t in itertools.combinations(range(40), 3) if all(p in {(a, b) for a, b, _ in rows} for p in itertools.combinations(t, 2))}
    assert {tuple(r) for r in graph.triangles(e).collect()} == tri
    dist = {0: 0}
    frontier = [0]
    while frontier:
        nxt = []
        for v in frontier:
            for a, b, _ in rows:
                for x, y in ((a, b), (b, a)):
                    if x == v and y not in dist:
                        dist[y] = dist[v] + 1
                        nxt.append(y)
        frontier = nxt
    assert {r["id"]: r["depth"] for r in graph.bfs_shells(e, 0).collect()} == dist
    best = {0: 0.0}
    for _ in range(40):
        for a, b, w in rows:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + w < best.get(y, math.inf):
                    best[y] = best[x] + w
    got = {r["id"]: r["distance"] for r in graph.shortest_paths(e, spark.range(1)).collect()}
    assert got.keys() == best.keys() and all(math.isclose(got[k], best[k]) for k in best)
    assert graph.shortest_paths(e, spark.range(1), bound=0.5).where("distance > 0.5").count() == 0
    c = graph.connectivity(e, nodes).first()
    assert c["components"] == len(set(roots(40, rows).values())) and c["cyclomatic"] == len(rows) - 40 + c["components"]


def test_partition_indices(spark):
    rng = np.random.default_rng(0)
    p, r = rng.integers(-1, 4, 200), rng.integers(0, 3, 200)
    d = spark.createDataFrame(list(zip(p.tolist(), r.tolist())), "predicted long, reference long")
    got = evaluate.external_indices(evaluate.contingency(d)).first()
    k = p >= 0
    p, r = p[k], r[k]
    pairs = list(itertools.combinations(range(len(p)), 2))
    agree = sum((p[i] == p[j]) == (r[i] == r[j]) for i, j in pairs)
    assert got["n"] == len(p) and math.isclose(got["rand"], agree / len(pairs))
    purity = sum(np.bincount(r[p == c]).max() for c in set(p.tolist())) / len(p)
    assert math.isclose(got["purity"], purity) and -0.1 < got["adjusted_rand"] < 0.1
    perfect = spark.createDataFrame([(i % 3, i % 3 + 5) for i in range(30)], "predicted long, reference long")
    one = evaluate.external_indices(evaluate.contingency(perfect)).first()
    assert all(math.isclose(one[c], 1) for c in ("rand", "adjusted_rand", "nmi", "homogeneity", "completeness", "v_measure", "purity"))


def test_validity_conventions(spark):
    _, p = cloud(spark, 10)
    one = p.withColumn("label", F.lit(0))
    assert math.isnan(evaluate.davies_bouldin(one).first()[0]) and math.isnan(evaluate.calinski_harabasz(one).first()[0])
    assert {r["silhouette"] for r in evaluate.silhouette(one).collect()} == {0.0}
    two = p.withColumn("label", F.when(F.col("id") == 0, 1).otherwise(F.lit(0)))
    assert evaluate.silhouette(two).where("id = 0").first()["silhouette"] == 0
    x, q = cloud(spark, 30)
    lab = np.arange(30) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(30):
        a = d[i][(lab == lab[i])].sum() / (np.sum(lab == lab[i]) - 1)
        b = min(d[i][lab == c].mean() for c in range(3) if c != lab[i])
        want.append((b - a) / max(a, b))
    got = {r["id"]: r["silhouette"] for r in evaluate.silhouette(q.withColumn("label", (F.col("id") % 3).cast("int")), block=7).collect()}
    assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in range(30))


def complex_rows(top, values=None):
    cells = set()
    for t in top:
        for k in range(1, len(t) + 1):
            cells |= set(itertools.combinations(sorted(t), k))
    return [(len(c) - 1, float(len(c) - 1), c) for c in cells]


def test_barcodes_of_known_spaces(spark):
    sphere = complex_rows(list(itertools.combinations(range(4), 3)))
    torus = complex_rows([tuple(sorted((r * 3 + c, r * 3 + (c + 1) % 3, (r + 1) % 3 * 3 + c))) for r in range(3) for c in range(3)] + [tuple(sorted((r * 3 + (c + 1) % 3, (r + 1) % 3 * 3 + c, (r + 1) % 3 * 3 + (c + 1) % 3))) for r in range(3) for c in range(3)])
    for cells, betti in ((sphere, (1, 0, 1)), (torus, (1, 2, 1))):
        bars = topology.reduce_boundary(cells)
        assert tuple(sum(d == k and math.isinf(y) for d, _, y in bars) for k in range(3)) == betti
    d = spark.createDataFrame([(g, *c[:2], list(c[2])) for g, cells in enumerate((sphere, torus)) for c in cells], "group long, dim int, value double, vertices array<long>")
    b = topology.barcodes(d).where(F.col("death") == float("inf")).groupBy("group", "dim").count().collect()
    assert {(r["group"], r["dim"]): r["count"] for r in b} == {(0, 0): 1, (0, 2): 1, (1, 0): 1, (1, 1): 2, (1, 2): 1}


def test_h0_bars_agree_with_reduction(spark):
    rows, e, nodes = random_graph(spark, 20, 30)
    bars = sorted(r["death"] for r in topology.barcode_h0(e, nodes).collect())
    cells = [(0, 0.0, (i,)) for i in range(20)] + [(1, w, (a, b)) for a, b, w in rows]
    assert bars == sorted(y for d, _, y in topology.reduce_boundary(cells) if d == 0)


def test_covers(spark):
    v = spark.createDataFrame([(i, float(i)) for i in range(11)] + [(99, math.nan), (98, None)], "id long, value double")
    c = {}
    for r in topology.uniform_cover(v, 3, 0.5).collect():
        c.setdefault(r["bin"], set()).add(r["id"])
    assert c == {0: set(range(0, 6)), 1: {3, 4, 5, 6, 7}, 2: set(range(5, 11))}
    assert {r["bin"] for r in topology.uniform_cover(v.where("id = 3"), 4, 0.2).collect()} == {0}
    b = topology.balanced_cover(v, 2, 0.0).groupBy("bin").count().collect()
    assert {r["bin"]: r["count"] for r in b} == {0: 5, 1: 6}


def test_clusterings_find_blobs(spark):
    p = synthetic.spatial_blobs(spark, 3, 80, spread=0.2)
    truth = p.select("id", F.col("label").alias("reference"))

    def score(labels):
        t = labels.select("id", F.col("label").alias("predicted")).join(truth, "id")
        return evaluate.external_indices(evaluate.contingency(t)).first()["adjusted_rand"]

    assert score(cluster.kmeans(p, 3)[1]) > 0.99
    h = cluster.hdbscan(p)
    assert score(h) > 0.95 and h.where("label >= 0").count() > 200
    assert score(cluster.responsibilities(p, cluster.gaussian_mixture(p, 3))) > 0.99
    assert [r["k"] for r in cluster.bic_sweep(p, [1, 3]).where("best").collect()] == [3]


def test_density_tree_over_all_pairs(spark):
    """However points are dealt to blocks, the tree is Kruskal's over every pair's mutual reachability."""
    rng = np.random.default_rng(3)
    x = np.round(np.r_[rng.normal(0, 1, (40, 2)), rng.normal(30, 1, (30, 2)), np.zeros((5, 2))], 1)  # far groups, equal points, ties
    p = spark.createDataFrame([(7 * i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    core = np.sort(d + np.diag(np.full(len(x), np.inf)), 1)[:, 4]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    pairs = sorted((reach[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    root, want = list(range(len(x))), set()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for w, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            want.add((7 * i, 7 * j, round(float(w), 9)))
    own = spark.createDataFrame([(7 * i, float(c)) for i, c in enumerate(core)], "id long, core double")
    for block in (2048, 20):
        got = {(r["src"], r["dst"], round(r["d"], 9)) for r in cluster.reachability_forest(p, own, block=block).collect()}
        assert got == want
    a, b = ({r["id"]: r["label"] for r in cluster.hdbscan(p, block=k).collect()} for k in (2048, 20))
    assert a == b and len(set(a.values()) - {-1}) == 2


def test_condensation_handles_equal_points(spark):
    p = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(12)] + [(20 + i, [5.0 + 0.1 * i, 0.0]) for i in range(12)], "id long, features array<double>")
    assert cluster.hdbscan(p).count() == 24


@pytest.mark.parametrize("name", sorted(synthetic.GENERATORS))
def test_generators(spark, name):
    g = synthetic.GENERATORS[name](spark)
    a, b = g.repartition(3).orderBy("id").limit(50).collect(), g.repartition(1).orderBy("id").limit(50).collect()
    assert a == b and g.where(F.exists("features", lambda x: F.isnan(x) | x.isNull())).count() == 0
    if name == "simplex_clusters":
        assert all(math.isclose(sum(r["features"]), 1) for r in a)
    if name.startswith("hyperbolic"):
        assert all(sum(x * x for x in r["features"]) < 1 for r in g.collect())


def test_search_sends_candidates_not_points(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.random((150, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    monkeypatch.setattr(neighbours, "SENT", 100)  # five chunks
    e = neighbours.epsilon_ball(points, 0.4, "manhattan", 16)
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    d = np.abs(x[:, None] - x[None]).sum(-1).round(9)
    assert {(r["src"], r["dst"]) for r in e.collect()} == {(i, j) for i, j in zip(*np.nonzero(d < 0.4)) if i != j}
    assert neighbours.epsilon_ball(points.where("id < 0"), 0.4).count() == 0


@pytest.mark.parametrize("block, sent", [(2048, 1 << 22), (16, 100), (13, 1 << 22)])
def test_ball_gives_pairs_both_ways_at_once(spark, monkeypatch, block, sent):
    x = np.random.default_rng(1).random((190, 3))
    ids = [i - i % 2 if i < 8 else i for i in range(190)]  # some twice
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, features array<double>")
    monkeypatch.setattr(neighbours, "SENT", sent)
    monkeypatch.setattr(neighbours, "PART", 50)
    monkeypatch.setattr(neighbours, "RUN", 4)
    got = [tuple(r) for r in neighbours.epsilon_ball(points, 0.9, "manhattan", block).collect()]
    d = np.abs(x[:, None] - x[None]).sum(-1).round(9)
    assert sorted(got) == sorted((ids[i], ids[j], d[i, j]) for i, j in zip(*np.nonzero(d < 0.9)) if ids[i] != ids[j])
    assert all((b, a, v) in got[max(0, k - 4) : k + 5] for k, (a, b, v) in enumerate(got))
