"""Hand-made cases and invariants."""

import inspect
import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from histoplane.functions import moments as M
from histoplane.functions.palette import CELL_TYPES, palette, type_colours
from histoplane.functions.stats import benjamini_hochberg, incomplete_beta
from histoplane.operators import cells as C
from histoplane.operators import clustering as K
from histoplane.operators import expression as X
from histoplane.operators import geometry as G
from histoplane.operators import neighbourhoods as H
from histoplane.operators import network as W
from histoplane.operators.neighbours import knn, points
from histoplane.plans.storage import numbered
from histoplane.plans.views import register_views
from histoplane.sources import io


def table(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, X double, Y double, celltype string")


def test_prepare(spark):
    rows = [("a", "1", "2", "T"), ("b", "NaN", "2", "T"), ("c", "Infinity", "1", "T"), ("d", "x", "1", "T"), ("e", "3", None, "T"), ("f", "4", "5", None)]
    out = C.prepare_data(spark.createDataFrame(rows, "V1 string, x string, y string, celltype string"))
    assert [tuple(r) for r in out.select("Cell_ID", "X", "Y").collect()] == [("a", 1.0, 2.0)]
    both = C.prepare_data(spark.createDataFrame([("new", "old", 1.0, 1.0)], "V1 string, Cell_ID string, X double, Y double"))
    assert both.columns.count("Cell_ID") == 1 and both.first()["Cell_ID"] == "new"
    numbered = C.prepare_data(spark.createDataFrame([(2.0, 1.0), (1.0, 1.0)], "X double, Y double"))
    assert sorted(r["Cell_ID"] for r in numbered.collect()) == [1, 2]
    with pytest.raises(ValueError):
        C.prepare_data(spark.createDataFrame([(1,)], "cell long"))


def test_filter_strict(spark):
    same = spark.createDataFrame([(i, 5.0, 3) for i in range(5)], "cell_id long, n_count double, n_feature long")
    assert C.filter_data(same).count() == 0


@pytest.mark.parametrize("values", [[], [None, 3.0], [1.0, 2.0], list(range(997)), [5.0] * 900 + [7.0] * 90 + [9.5], [math.exp(i / 3) for i in range(1500)] + [None] * 40 + [-2.0] * 333, [1.0, float("nan")] * 300])
def test_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(M, "AT_ONCE", 25)
    monkeypatch.setattr(M, "ACCURACY", 50)
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0] or [None] * len(shares)
    assert repr(M.exact_quantiles(df, "v", shares)) == repr(list(want))


def test_covariance(spark):
    x = np.random.default_rng(3).normal(100, 2, (300, 7)) * (np.random.default_rng(4).random((300, 7)) < 0.7)
    rows = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x], "at array<int>, val array<double>")
    for shift in ([0.0] * 7, [100.0] * 7):
        assert np.allclose(M.covariance(rows.repartition(4), 7, shift), np.cov(x.T), rtol=1e-9)
    assert not M.covariance(rows.limit(0), 7, [0.0] * 7).any()


def test_numbered(spark):
    df = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "X double, i int").repartition(5)
    assert sorted((r.n, r.X) for r in numbered(df, ["X"], "n").collect()) == [(i + 1, float(i)) for i in range(101)]
    assert numbered(df.limit(0), ["X"], "n").collect() == []


def test_log_ratio_by_feature_equals_windows(spark):
    expr = spark.createDataFrame([(c, f, float((c * 3 + k) % 5)) for c in range(6) for k, f in enumerate(("a", "b", None))] + [(9, "z", 0.0)], "cell_id long, feature string, value double")
    w = Window.partitionBy("feature")
    log = F.when(F.col("value") > 0, F.log1p("value"))
    full = expr.withColumn("value", F.log1p(F.col("value") / F.exp(F.sum(F.coalesce(log, F.lit(0.0))).over(w) / F.count("*").over(w))))
    mean = F.avg(log).over(w)
    positive = expr.withColumn("value", F.when(mean.isNull(), F.col("value")).otherwise(F.log1p(F.col("value") / F.exp(mean))))
    rows = lambda df: sorted((r.cell_id, str(r.feature), round(r.value, 9)) for r in df.collect())
    assert rows(X.centred_log_ratio(expr, "feature")) == rows(full)
    assert rows(X.centred_log_ratio_nonzero(expr, "feature")) == rows(positive)


def test_annotate(spark):
    df = spark.createDataFrame([("0",), ("1",), ("9",)], "cluster string")
    out = C.annotate_celltypes(df, [0, 1, 0], ["a", "b", "c"])
    assert [r.celltype for r in out.orderBy("cluster").collect()] == ["a", "b", None]
    with pytest.raises(ValueError):
        C.annotate_celltypes(df, [0], [])
    with pytest.warns(UserWarning):
        assert C.unknown_clusters(df, ["0", "7"]) == ["7"]


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(1)
    xy = np.vstack((rnd.normal(0, 1, (150, 2)), rnd.normal(500, 0.1, (60, 2)), [[0.0, 0.0]] * 4, [[1e4, 1e4]]))
    df = table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)])
    got = {(r.id, r.rn): r.nid for r in knn(points(df), 5).collect()}
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(1)
        order = [j for j in sorted(range(len(xy)), key=lambda j: (d[j], j)) if j != i][:5]
        assert [got[i, r + 1] for r in range(5)] == order
    few = knn(points(df.where("cell_id < 3")), 10).collect()
    assert len(few) == 6
    assert knn(points(df.where("cell_id < 1")), 3).count() == 0 and knn(points(df.where("false")), 3).count() == 0


@pytest.mark.parametrize("text_ids", [False, True])
def test_knn_over_many_tiles(spark, monkeypatch, text_ids):
    from histoplane.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE_POINTS", 24)
    monkeypatch.setattr(neighbours, "TASK_QUERIES", 10)
    rnd = np.random.default_rng(2)
    xy = np.vstack((rnd.normal(0, 1, (200, 2)), rnd.normal(500, 0.1, (80, 2)), [[0.0, 0.0]] * 30, [[1e4, 1e4], [-1e5, 3.0]], rnd.integers(0, 4, (60, 2))))
    ids = [f"c{i:04d}" if text_ids else i for i in range(len(xy))]
    kinds = ["rare" if i in (3, 311) else "ab"[i % 2] for i in range(len(xy))]
    df = spark.createDataFrame([(c, float(x), float(y), t) for c, (x, y), t in zip(ids, xy, kinds)] + [("none" if text_ids else 9999, None, 1.0, "a")], f"id {'string' if text_ids else 'long'}, x double, y double, t string")
    got = {(r.id, r.rn): r.nid for r in knn(df, 5).collect()}
    of_type = {(r.id, r.t, r.rn): r.nid for r in knn(df, 3, by="t").collect()}
    want, want_type = {}, {}
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i]
        want |= {(ids[i], r + 1): ids[j] for r, j in enumerate(order[:5])}
        for t in ("a", "b", "rare"):
            want_type |= {(ids[i], t, r + 1): ids[j] for r, j in enumerate([j for j in order if kinds[j] == t][:3])}
    assert got == want and of_type == want_type


def scattered(n, seed):
    rnd = np.random.default_rng(seed)
    xy = np.vstack((rnd.normal(0, 30, (n, 2)), rnd.integers(0, 5, (n // 3, 2)) * 4.0, [[7.0, -3.0]] * 40, [[1e5, -1e5]]))
    return xy, ["ABC"[i % 3] if i % 7 else None for i in range(len(xy))]


def test_radius_graph_pairs_once_and_unshuffled(spark, monkeypatch):
    from histoplane.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE_ROWS", 20)
    xy, _ = scattered(300, 5)
    df = table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)] + [(9999, None, 1.0, "t")])
    edges = W.edges_radius(df, 8.0, None)
    got = edges.collect()
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(2)
    assert len(got) == len({(r["from"], r["to"]) for r in got}) == ((d2 <= 64.0).sum() - len(xy)) / 2
    assert all(r["from"] < r["to"] and abs(r.dist - d2[r["from"], r["to"]] ** 0.5) < 1e-9 for r in got)
    # pairs are neither aggregated nor dealt
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    # a capped graph has no more rows than its cap
    order = np.argsort(np.where(np.eye(len(xy)) > 0, np.inf, d2), axis=1, kind="stable")
    cap = W.degree_cap(len(xy) + 1, float(np.ptp(xy[:, 0]) + 1e-8) * float(np.ptp(xy[:, 1]) + 1e-8), 8.0)
    want = {(min(i, j), max(i, j)) for i in range(len(xy)) for j in order[i, :cap].tolist() if d2[i, j] <= 64.0}
    capped = W.edges_radius(df, 8.0)
    assert {(r["from"], r["to"]) for r in capped.collect()} == want
    assert "Join" not in capped._jdf.queryExecution().optimizedPlan().toString()
    twice = table(spark, [(1, 0.0, 0.0, "t"), (2, 1.0, 0.0, "t"), (2, 0.5, 0.0, "t")])
    assert [tuple(r) for r in W.edges_radius(twice, 8.0, None).collect()] == [(1, 2, 0.5)]


@pytest.mark.parametrize("method", ["radius", "window"])
def test_purity_counts_match_brute_force(spark, monkeypatch, method):
    from histoplane.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE_ROWS", 20)
    monkeypatch.setattr(neighbours, "TYPES", 3)
    xy, kinds = scattered(400, 6)
    df = table(spark, [(i, float(x), float(y), t) for i, ((x, y), t) in enumerate(zip(xy, kinds))] + [(9999, None, 1.0, "A")])
    got = {r.cell_id: (r.neighbours, r.purity) for r in H.purity(df, method, radius=8.0).collect()}
    for i in range(len(xy)):
        d = xy - xy[i]
        near = (np.abs(d) <= 4.0).all(1) if method == "window" else ((d**2).sum(1) <= 64.0) & ((d**2).sum(1) > 0)
        near[i] = False
        of = [sum(kinds[j] == t for j in np.flatnonzero(near)) for t in ("A", "B", "C", None)]
        assert got[i] == (sum(of), max(of) / sum(of) if sum(of) >= 5 else None)
    assert got[9999] == (0, None)


def test_purity_of_many_cells_at_a_place(spark):
    # 60 000 cells at 100 places: over 10^9 pairs
    df = spark.range(60_000).selectExpr("id AS cell_id", "CAST(id % 10 AS double) AS X", "CAST(floor(id / 10) % 10 AS double) AS Y", "concat('T', id % 2) AS celltype")
    got = H.purity(df, "radius", radius=1.0)
    assert {tuple(r) for r in got.groupBy("neighbours").count().collect()} == {(1200, 4 * 600), (1800, 32 * 600), (2400, 64 * 600)}


def test_window_graph_matches_brute_force(spark):
    rnd = np.random.default_rng(4)
    xy = np.vstack((rnd.random((120, 2)) * 60, rnd.random((700, 2)) * 2 + 30))
    df = table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)])
    got = {(r["from"], r["to"]): r["dist"] for r in W.edges_window(df, 4, 10.0).collect()}
    tile, want = np.floor(xy / 10).astype(int), {}
    for b in {tuple(t) for t in tile}:
        at = np.flatnonzero((np.abs(tile - b) <= 1).all(1))
        for i in at:
            d = ((xy[at] - xy[i]) ** 2).sum(1)
            for j in [j for j in np.lexsort((at, d)) if at[j] != i][:4]:
                want[min(i, at[j]), max(i, at[j])] = d[j] ** 0.5
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


@pytest.mark.parametrize("square,spare", [(1, 1), (3, 2), (4, 4)])
def test_window_graph_looks_a_cell_up_once(spark, monkeypatch, square, spare):
    monkeypatch.setattr(W, "SQUARE", square)
    monkeypatch.setattr(W, "SPARE", spare)
    rnd = np.random.default_rng(14)
    xy = np.vstack((rnd.random((150, 2)) * 80 - 40, rnd.random((400, 2)) * 3, np.repeat([[10.0, 10.0], [-20.0, 5.0]], 15, axis=0), [[500.0, 500.0]]))
    df = table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)])
    got = {(r["from"], r["to"]): r["dist"] for r in W.edges_window(df, 4, 10.0).collect()}
    tile, want = np.floor(xy / 10).astype(int), {}
    for b in {tuple(t) for t in tile}:
        at = np.flatnonzero((np.abs(tile - b) <= 1).all(1))
        for i in at:
            d = ((xy[at] - xy[i]) ** 2).sum(1)
            for j in [j for j in np.lexsort((at, d)) if at[j] != i][:4]:
                want[min(i, at[j]), max(i, at[j])] = d[j] ** 0.5
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_network_invariants(spark):
    rnd = np.random.default_rng(2)
    df = table(spark, [(i, float(x), float(y), "AB"[i % 2]) for i, (x, y) in enumerate(rnd.uniform(0, 100, (80, 2)))])
    at = {r.cell_id: (r.X, r.Y) for r in df.collect()}
    for method in ("knn", "radius", "delaunay", "window", "auto"):
        net = W.build_spatial_network(df, method=method, window_size=25.0)
        edges = net.edges.collect()
        assert edges and all(e["from"] < e["to"] and abs(e.dist - math.dist(at[e["from"]], at[e["to"]])) < 1e-9 for e in edges)
        assert all(e.same_type == (e.from_type == e.to_type) for e in edges)
        assert len({(e["from"], e["to"]) for e in edges}) == len(edges)
    capped = W.build_spatial_network(df, method="knn", max_edges=10).edges
    assert capped.count() == 10 and sorted(map(tuple, capped.collect())) == sorted(map(tuple, W.build_spatial_network(df, method="knn", max_edges=10).edges.collect()))
    assert W.build_spatial_network(df.limit(1)).edges.count() == 0
    with pytest.raises(ValueError):
        W.build_spatial_network(df, method="other")


def test_choice():
    m = lambda **k: W.SpatialMetrics(**({"n": 100, "mean_nn": 5.0, "cv_nn": 0.5, "clark_evans": 1.0, "gini_simpson": 0.5, "moran": 0.0, "area": 1.0} | k))
    assert W.select_method(m(n=60_000)) == ("window", {"k": 6})
    assert W.select_method(m(moran=0.4))[0] == "radius"
    assert W.select_method(m(cv_nn=0.2))[0] == "knn" and W.select_method(m(cv_nn=0.2, clark_evans=1.1))[0] == "radius"
    assert W.select_method(m()) == ("delaunay", {"max_edge_length": 10.0})
    with pytest.warns(UserWarning):
        W.select_method(m(moran=None))
    assert [W.default_k(n) for n in (500, 1500, 15_000)] == [19, 21, 25]


def test_window_size_can_stall(spark):
    df = table(spark, [(i, float(i % 10) * 10, float(i // 10) * 10, "t") for i in range(100)])
    with pytest.warns(UserWarning):
        w = W.optimal_window_size(df)
    assert w.window_size == 2 and not w.converged
    assert W.optimal_window_size(table(spark, [(1, 1.0, 1.0, "t")])).mean_cells is None


def test_merge_protein_unmatched(spark):
    cells = spark.createDataFrame([("Cell_1", 1.0, 2.0, "A"), ("Cell_2", 3.0, 4.0, "B")], "Cell_ID string, X double, Y double, Neighborhood_Cluster string")
    wide = spark.createDataFrame([("1", 0.5), ("9", 0.7)], "Cell_ID string, p2 double")
    assert [tuple(r) for r in X.merge_protein(cells, wide).orderBy("Cell_ID").select("Cell_ID", "X", "Y", "p2", "Spatial_Zone").collect()] == [("1", 1.0, 2.0, 0.5, "A"), ("2", 3.0, 4.0, None, "B")]


def test_expression_clusters_on_all_components(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(0, 1, 2)] + [1000.0 * (i % 2)]) for i in range(50)]
    found = {r.id: r.cluster for r in K.expression_clusters(spark.createDataFrame(rows, "cell_id long, vec array<double>"), k=6).collect()}
    assert len(found) == 50 and not {found[i] for i in range(0, 50, 2)} & {found[i] for i in range(1, 50, 2)}


@pytest.mark.parametrize("text_ids", [False, True])
def test_nearest_in_components_by_blocks(spark, monkeypatch, text_ids):
    from histoplane.operators import local, process

    monkeypatch.setattr(process, "QUERIES", 100)
    monkeypatch.setattr(process, "CANDIDATES", 150)
    monkeypatch.setattr(local, "boxes", lambda v, most, real=local.boxes: real(v, min(most, 32)))
    rnd = np.random.default_rng(9)
    v = np.vstack((np.round(rnd.normal(0, 1, (350, 4)), 1), np.zeros((60, 4)), [[1e4, 0, 0, 0]]))  # ties and copies
    ids = [f"c{i:04d}" if text_ids else i for i in range(len(v))]
    df = spark.createDataFrame([(c, [float(x) for x in r]) for c, r in zip(ids, v)], f"cell_id {'string' if text_ids else 'long'}, vec array<double>")
    got = {(r.id, r.rn): (r.nid, r.d2) for r in process.nearest_in_components(df, 3, 7).collect()}
    assert len(got) == 7 * len(v)
    for i in range(len(v)):
        d = ((v[:, :3] - v[i, :3]) ** 2).sum(1)
        for rn, j in enumerate([j for j in np.lexsort((np.arange(len(v)), d)) if j != i][:7], 1):
            assert got[ids[i], rn] == (ids[j], d[j])


def test_louvain_of_arrays():
    rnd = np.random.default_rng(10)
    a, b = (np.concatenate([c * 40 + rnd.integers(0, 40, 400) for c in range(5)] + [rnd.integers(0, 200, 60)]) for _ in range(2))
    w = rnd.random(len(a))
    labels = K.louvain((a, b, w), 200)
    assert labels == K.louvain(list(zip(a.tolist(), b.tolist(), w.tolist())), 200)
    assert sorted(set(labels)) == [1, 2, 3, 4, 5] and all(len(set(labels[40 * c : 40 * c + 40])) == 1 for c in range(5))
    assert K.louvain([], 0) == [] and K.louvain([], 3) == [1, 2, 3]


def test_kmeans_starts():
    assert inspect.signature(K.kmeans).parameters["seeds"].default == 25


def test_kmeans_starts_share_their_passes(spark):
    rnd = np.random.default_rng(8)
    at = np.repeat([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0], [30.0, 30.0]], [50, 40, 30, 20], axis=0) + rnd.normal(0, 0.3, (140, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(at)], "cell_id long, vec array<double>")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kmeans", "")
    got = {r.cell_id: r.Neighborhood_Cluster for r in K.kmeans(df, 4).collect()}
    jobs = len(seen.getJobIdsForGroup("kmeans"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[i] for i in range(140)] == ["CN1"] * 50 + ["CN2"] * 40 + ["CN3"] * 30 + ["CN4"] * 20
    assert jobs < 25  # 25 starts of several jobs each
    assert {r.cell_id: r.Neighborhood_Cluster for r in K.kmeans(df.repartition(5), 4).collect()} == got
    few = K.kmeans(df.withColumn("vec", F.array((F.col("cell_id") % 3).cast("double"))), 5).collect()
    assert len(few) == 140 and len({r.Neighborhood_Cluster for r in few}) == 3


@pytest.mark.parametrize("n", [3, 4, 50, 600])
def test_delaunay(n):
    xy = np.random.default_rng(n).uniform(0, 10, (n, 2))
    t = G.delaunay(xy)
    e = G.delaunay_pairs(xy)
    h = len(G.hull(xy))
    assert len(e) == 3 * n - 3 - h and len(t) == 2 * n - 2 - h
    for a, b, c in t[:: max(1, len(t) // 40)]:
        m = np.array([[xy[p, 0], xy[p, 1], (xy[p] ** 2).sum(), 1.0] for p in (a, b, c)])
        side = np.sign(np.linalg.det(m[:, [0, 1, 3]]))
        for p in range(n):
            if p not in (a, b, c):
                assert side * np.linalg.det(np.vstack((m, [xy[p, 0], xy[p, 1], (xy[p] ** 2).sum(), 1.0]))) <= 1e-6


@pytest.mark.parametrize("kind", ["normal", "grid", "clumps", "line"])
def test_delaunay_over_many_tiles(spark, monkeypatch, kind):
    rnd = np.random.default_rng(11)
    xy = {
        "normal": rnd.normal(0, 100, (900, 2)),
        "grid": np.array([(float(i), float(j)) for i in range(12) for j in range(12)]) + 0.0,
        "clumps": np.vstack([rnd.normal(c, 1.0, (150, 2)) for c in ((0, 0), (500, 0), (0, 900))] + [[[4e4, -3e4], [0.0, 0.0], [0.0, 0.0]]]),
        "line": np.column_stack((rnd.permutation(300) * 1.0, np.zeros(300))),
    }[kind]
    df = table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)] + [(99_999, None, 0.0, "t")])
    monkeypatch.setattr(G, "TILE_POINTS", 40)
    edges = G.edges_delaunay(df)
    got = [(r["from"], r["to"]) for r in edges.collect()]
    areas = {r.cell_id: r.area for r in G.voronoi_areas(G.voronoi(df)).collect()}
    monkeypatch.setattr(G, "TILE_POINTS", 10**6)
    want = {tuple(e) for e in G.delaunay_pairs(xy).tolist()}
    assert len(got) == len(set(got))
    if kind == "grid":  # diagonals are free, their number and the sides are not
        assert len(got) == len(want) and {e for e in got if np.abs(xy[e[0]] - xy[e[1]]).sum() == 1} == {e for e in want if np.abs(xy[e[0]] - xy[e[1]]).sum() == 1}
    else:
        assert set(got) == want
    assert abs(sum(areas.values()) - np.ptp(xy[:, 0]) * np.ptp(xy[:, 1])) <= 1e-6 * max(1.0, np.ptp(xy[:, 0]) * np.ptp(xy[:, 1]))


def test_delaunay_tiles_leave_few_open(spark, monkeypatch):
    # the one task gets the rim of what tiles leave open, not all points
    seen, real = [], G.keep
    monkeypatch.setattr(G, "keep", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    monkeypatch.setattr(G, "TILE_POINTS", 200)
    xy = np.random.default_rng(12).normal(0, 100, (6000, 2))
    assert G.edges_delaunay(table(spark, [(i, float(x), float(y), "t") for i, (x, y) in enumerate(xy)])).count() == 3 * 6000 - 3 - len(G.hull(xy))
    assert dict(seen)["sure-edges"].where("n = 1").count() < 400


def test_delaunay_degenerate():
    assert G.delaunay_pairs(np.array([[0.0, 0.0], [1, 0], [2, 0], [5, 0]])).tolist() == [[0, 1], [1, 2], [2, 3]]
    assert G.delaunay_pairs(np.array([[0.0, 0.0], [0, 0]])).tolist() == [[0, 1]]
    assert len(G.delaunay_pairs(np.array([[0.0, 0.0]]))) == 0


def test_features_and_interactions(spark):
    df = table(spark, [(1, 0.0, 0.0, "A"), (2, 1.0, 0.0, "A"), (3, 0.0, 2.0, "B"), (4, 9.0, 9.0, "B")])
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (3, 1, 2.0)], "`from` long, `to` long, dist double")
    f = {r.cell_id: r for r in H.neighbourhood_features(df, edges, ["A", "B"]).collect()}
    assert (f[1].Nbr_A, f[1].Nbr_B, f[1].Centroid_X, f[1].Rel_Y) == (0.5, 0.5, 0.5, 1.0)
    assert (f[4].Nbr_A, f[4].Centroid_X, f[4].Rel_X) == (0.0, 0.0, -9.0)
    m = {(r.type1, r.type2): r.n for r in H.interactions(df, edges.where("`from` = 1")).collect()}
    assert m == {("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 0}
    p = {r.cell_id: (r.neighbours, r.purity) for r in H.purity(df, "radius", radius=2.5, min_cells=2).collect()}
    assert p[1] == (2, 0.5) and p[4] == (0, None)
    with pytest.raises(ValueError):
        H.purity(df, "other")


def test_statistics(spark):
    assert abs(incomplete_beta(2.0, 3.0, 0.4) - 0.5248) < 1e-12 and incomplete_beta(1, 1, 0) == 0.0
    df = spark.createDataFrame([("a", "x", 0.01), ("a", "y", 0.02), ("a", "z", 0.03), ("a", "w", None)], "g string, t string, p double")
    out = {r.t: r.adj for r in benjamini_hochberg(df, "p", ["g"], ["t"], "adj").collect()}
    assert all(abs(out[k] - 0.03) < 1e-12 for k in "xyz") and out["w"] is None


def test_differential_expression(spark):
    rnd = np.random.default_rng(3)
    cells = spark.createDataFrame([(i, str(i % 2)) for i in range(60)] + [(99, "alone")], "cell_id long, cluster string")
    values = [(i, "up", float(rnd.normal(3 * (i % 2), 1))) for i in range(60)] + [(i, "flat", 1.0) for i in range(60)] + [(i, "none", None) for i in range(60)]
    out = {(r.Protein, r.Cluster): r for r in X.differential_expression(spark.createDataFrame(values, "cell_id long, feature string, value double"), cells).collect()}
    assert out["up", "1"].Significance == "Up" and out["up", "0"].Significance == "Down"
    assert out["flat", "1"].p_value is None and out["flat", "1"].Significance is None
    assert not any(k[1] == "alone" for k in out)
    a, b = [v for i, f, v in values if f == "up" and i % 2], [v for i, f, v in values if f == "up" and not i % 2]
    assert abs(out["up", "1"].MeanDiff - (np.mean(a) - np.mean(b))) < 1e-9


def test_graph_clusters(spark):
    ring = [(a, b) for c in range(4) for a in range(6 * c, 6 * c + 6) for b in range(a + 1, 6 * c + 6)] + [(5, 6), (11, 12), (17, 18)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ring], "`from` long, `to` long, dist double")
    labels = K.graph_clusters(edges)
    by = {r.id: r.cluster for r in labels.collect()}
    assert len(set(by.values())) == 4 and all(by[i] == by[6 * (i // 6)] for i in by)
    assert K.modularity(edges, labels).first()[0] > 0.6


def test_density_labels():
    rnd = np.random.default_rng(0)
    v = np.vstack((rnd.normal(0, 0.1, (40, 2)), rnd.normal(5, 0.1, (30, 2)), [[20.0, -20.0]]))
    labels = K.density_labels(v, 5)
    assert labels[:40].tolist() == [1] * 40 and labels[40:70].tolist() == [2] * 30 and labels[70] == 0


def clumps():
    """Groups far apart and near ones, copies, ties and single rows."""
    rnd = np.random.default_rng(11)
    far = [rnd.normal(0, 0.1, (150, 3)) + c for c in ([0, 0, 0], [40, 0, 0], [40, 1, 0], [0, 300, 0])]
    return np.vstack((*far, np.full((30, 3), 7.0), np.round(rnd.normal(5, 1, (120, 3)), 1), [[1e4, 0, 0], [0, -1e4, 0]]))


def test_density_tree_by_parts(spark, monkeypatch):
    v = clumps()
    n = len(v)
    monkeypatch.setattr(K, "CANDIDATES", 200)
    monkeypatch.setattr(K, "QUERIES", 50)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "_i long, vec array<double>")
    k = 6
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    lists = {r._i: (r.near, r.d2) for r in K.near_lists(rows, n, k).collect()}
    assert sorted(lists) == list(range(n))
    for i in range(n):
        want = [j for j in np.lexsort((np.arange(n), ((v - v[i]) ** 2).sum(1))) if j != i][:k]
        assert lists[i] == (want, ((v[want] - v[i]) ** 2).sum(1).tolist())
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    best, done, want, at = np.full(n, np.inf), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        done[at] = True
        best = np.minimum(best, reach[at])
        at = int(np.argmin(np.where(done, np.inf, best)))
        want.append(best[at])
    w, a, b = K.reachability_tree(rows, n, k)
    assert sorted(w) == sorted(want) and (w == reach[a, b]).all()
    up = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        assert x != y
        up[x] = y


@pytest.mark.parametrize("text_ids", [False, True])
def test_hdbscan_by_parts(spark, monkeypatch, text_ids):
    monkeypatch.setattr(K, "CANDIDATES", 400)
    v = clumps()
    ids = [f"c{i:04d}" if text_ids else i for i in range(len(v))]
    df = spark.createDataFrame([(c, "x", [float(x) for x in r]) for c, r in zip(ids, v)], f"cell_id {'string' if text_ids else 'long'}, kept string, vec array<double>")
    got = K.hdbscan(df.repartition(5))
    assert got.columns == ["cell_id", "kept", "vec", "Neighborhood_Cluster"]
    labels = {r.cell_id: r.Neighborhood_Cluster for r in got.collect()}
    want = K.density_labels(v, max(5, len(v) // 100))
    assert labels == {c: f"CN{i}" for c, i in zip(ids, want)} and len(set(want)) > 4


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_hdbscan_of_few(spark, n):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "cell_id long, vec array<double>")
    assert {r.cell_id: r.Neighborhood_Cluster for r in K.hdbscan(df).collect()} == {i: "CN0" for i in range(n)}


def test_density_labels_follow_no_order():
    # the row at 0 reaches both groups at one height; wherever it stands in the table, it goes to neither
    left = np.array([-1.0, -1.1, -1.15, -1.2, -1.21])
    line = np.concatenate((left, -left, [0.0]))
    for at in range(len(line)):
        order = np.insert(np.arange(10), at, 10)
        labels = K.density_labels(line[order][:, None], 4)
        assert labels[at] == 0 and len(set(labels[order < 5])) == 1 and len(set(labels[(order >= 5) & (order < 10)])) == 1 and set(labels) == {0, 1, 2}


@pytest.mark.parametrize("scale", [1.0, 1e-18, 1e25])
def test_nearest_vectors_against_all(scale):
    from histoplane.operators.local import nearest_vectors

    rnd = np.random.default_rng(13)
    v = np.vstack((rnd.normal(0, 1, (5000, 12)), np.round(rnd.normal(0, 1, (800, 12))), np.full((200, 12), 0.5))) * scale
    ids = rnd.permutation(len(v))
    asked = np.concatenate((np.arange(0, 5000, 25), np.arange(5000, 6000, 20)))
    d = np.array([((v - v[i]) ** 2).sum(1) for i in asked])
    want = [[(d[n, j], ids[j]) for j in np.lexsort((ids, d[n])) if j != i][:15] for n, i in enumerate(asked)]
    r, j, e = nearest_vectors(v[asked], ids[asked], v, ids, 15)
    got = [[(x, y) for x, y in zip(e[r == n], ids[j[r == n]])] for n in range(len(asked))]
    assert got == want
    # the bound of a first part leaves what is nearer in the rest
    reach2 = np.array([np.sort(x)[8] for x in d])
    r, j, e = nearest_vectors(v[asked], ids[asked], v, ids, 15, reach2)
    assert [[(x, y) for x, y in zip(e[r == n], ids[j[r == n]])] for n in range(len(asked))] == [[x for x in w if x[0] <= m] for w, m in zip(want, reach2)]


def test_nearest_outside():
    from histoplane.operators.local import nearest_outside

    rnd = np.random.default_rng(12)
    v, core, of = rnd.normal(0, 1, (3000, 4)), rnd.random(3000) / 2, rnd.integers(0, 7, 3000)
    q = np.arange(0, 1200)
    reach = np.maximum(np.maximum(np.sqrt(((v[q][:, None] - v[None]) ** 2).sum(2)), core[None]), core[q][:, None])
    reach[of[q][:, None] == of[None]] = np.inf
    limit = np.full(7, np.inf)
    limit[2] = 1e-9
    c, w, a, b = nearest_outside(v[q], core[q], of[q], v, core, of, limit)
    assert c.tolist() == [0, 1, 3, 4, 5, 6]
    assert w.tolist() == [reach[of[q] == x].min() for x in c] and (reach[a, b] == w).all() and (of[q][a] == c).all()


def test_sources(spark, tmp_path):
    (tmp_path / "counts.csv").write_text("gene,c1,c2,c3\np1,1,0,5\np2,2,0,1\n")
    (tmp_path / "coords.csv").write_text("cell,a,b\nc1,1,2\nc3,3,4\nc9,5,6\n")
    data = io.load_spatial_data(spark, counts_file=str(tmp_path / "counts.csv"), coords_file=str(tmp_path / "coords.csv"))
    assert sorted((r.cell_id, r.X, r.n_count, r.n_feature) for r in data.cells.collect()) == [("c1", 1.0, 3.0, 2), ("c3", 3.0, 6.0, 2)]
    assert data.expr.count() == 4
    io.save_dataset(data, str(tmp_path / "saved"))
    assert io.load_spatial_data(spark, str(tmp_path / "saved")).cells.count() == 2
    (tmp_path / "m.csv").write_text("Centroid X um,Centroid Y um,CD3,CD8\n1,2,3,0\n4,5,6,7\n")
    m = io.load_spatial_data(spark, str(tmp_path / "m.csv"))
    assert m.cells.count() == 2 and m.expr.count() == 4
    with pytest.raises(ValueError):
        io.load_spatial_data(spark)


def test_palette():
    assert [len(palette(n)) for n in (1, 2, 9, 12, 40)] == [1, 2, 9, 12, 40] and len(set(palette(40))) == 40
    assert palette(13)[0] == palette(40)[0] == "#F8766D"  # 15 degrees
    assert type_colours(["b", "a", "b"]) == {"a": CELL_TYPES[0], "b": CELL_TYPES[1]} and len(set(type_colours(map(str, range(50))).values())) == 50


def test_views_are_tables(spark):
    names = register_views(spark, DATA, "v_")
    assert "v_small_cells" in names and spark.sql("SELECT celltype, count(*) AS n FROM v_small_cells GROUP BY 1").count() == spark.table("v_small_cells").select("celltype").distinct().count()
    assert all(spark.table(n).count() for n in names)


def test_marker_panel_of_a_layout(spark):
    layout = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.5, 3.0)], "id long, x double, y double")
    expr = spark.createDataFrame([(1, "a", 7.0), (1, "b", 8.0), (3, "a", 9.0)], "cell_id long, feature string, value double")
    got = X.marker_panel(layout, expr, None, "id", "x", "y").collect()
    assert sorted(map(tuple, got)) == [(1, 0.5, 2.0, "a", 7.0), (1, 0.5, 2.0, "b", 8.0)]



def test_dendrogram_order():
    from histoplane.operators.process import dendrogram_order

    m = np.array([[0.0], [10.0], [0.1], [10.1], [5.0]])
    for method in ("complete", "ward"):
        order = dendrogram_order(m, method)
        assert sorted(order) == [0, 1, 2, 3, 4] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1


def test_stream_ingest(spark, tmp_path):
    from histoplane.streaming.ingest import ingest_cells

    (tmp_path / "in").mkdir()
    table(spark, [(1, 0.0, 0.0, "A"), (2, float("nan"), 0.0, "A")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "cell_id long, X double, Y double, celltype string"
    ingest_cells(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "mark"))
    table(spark, [(3, 1.0, 1.0, "B"), (1, 0.0, 0.0, "A")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest_cells(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted(r.Cell_ID for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 1, 3]
