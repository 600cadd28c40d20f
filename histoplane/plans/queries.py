"""One query for each operator over the relational tables, beside the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import clustering as K
from ..operators import enrichment as N
from ..operators import expression as X
from ..operators import geometry as G
from ..operators import neighbourhoods as H
from ..operators import network as W
from ..operators.neighbours import knn, kth_distance, points
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TYPES_1 = [f"T{i}" for i in range(10)]
TYPES_2 = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FEATURES = [f"prot{i}" for i in range(2, 12)]
RADIUS = 120.0
TILE = 400.0


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _with_views(sql)
        return f

    return put


def _with_views(sql: str) -> str:
    """Puts the views and shared parts that a query names in front of it."""
    parts = {**V.SQL, **SHARED}
    used: list[str] = []

    def visit(text: str) -> None:
        for name in parts:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(parts[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    start, own = ("WITH RECURSIVE ", sql.startswith("WITH RECURSIVE ")) if "WITH RECURSIVE " in sql else ("WITH ", sql.startswith("WITH "))
    return start + ", ".join(f"{n} AS ({parts[n]})" for n in used) + (", " + sql[len(start) :] if own else " " + sql)


_PAIRS = "SELECT a.cell_id AS id, b.cell_id AS nid, a.celltype AS t, b.celltype AS nt, (a.X-b.X)*(a.X-b.X)+(a.Y-b.Y)*(a.Y-b.Y) AS d2 FROM c1 a JOIN c1 b ON a.cell_id <> b.cell_id"
SHARED = {
    "pair1": _PAIRS,
    "nn1": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS rn FROM pair1",
    "edge1": "SELECT least(id,nid) AS a, greatest(id,nid) AS b, sqrt(min(d2)) AS dist FROM nn1 WHERE rn <= 6 GROUP BY 1, 2",
    "adj1": "SELECT a AS id, b AS nid FROM edge1 UNION SELECT b, a FROM edge1",
    "typ1": "SELECT DISTINCT celltype AS t FROM c1",
    "met1": """WITH n AS (SELECT count(*) AS n, (max(X)-min(X)+1e-8)*(max(Y)-min(Y)+1e-8) AS area FROM c1), k AS (SELECT id, sqrt(max(d2)) AS d FROM nn1 WHERE rn <= 10 GROUP BY 1),
    f AS (SELECT avg(sqrt(d2)) AS m FROM nn1 WHERE rn = 1), g AS (SELECT 1 - sum(c * c) / (sum(c) * sum(c)) AS g FROM (SELECT count(*)::DOUBLE AS c FROM c1 GROUP BY celltype)),
    w AS (SELECT id, nt, (1 / (sqrt(d2) + 2.220446049250313e-16)) / sum(1 / (sqrt(d2) + 2.220446049250313e-16)) OVER (PARTITION BY id) AS w FROM nn1, n WHERE rn <= greatest(5, least(20, round_even(sqrt(n), 0)))),
    p AS (SELECT celltype AS t, count(*) / any_value(n.n) AS p FROM c1, n GROUP BY 1), s AS (SELECT id, nt, sum(w) AS s FROM w GROUP BY 1, 2),
    z AS (SELECT p.t, p.p, sum(((c1.celltype = p.t)::INT - p.p) * (coalesce(s.s, 0) - p.p)) / (any_value(n.n) * p.p * (1 - p.p)) AS i FROM c1 CROSS JOIN p CROSS JOIN n LEFT JOIN s ON s.id = c1.cell_id AND s.nt = p.t GROUP BY 1, 2)
    SELECT (SELECT n FROM n) AS n, avg(d) AS mean_nn, stddev_samp(d) / avg(d) AS cv_nn, (SELECT m / (0.5 / sqrt(n / area)) FROM f, n) AS clark_evans, (SELECT g FROM g) AS gini_simpson, (SELECT sum(p * i) / sum(p) FROM z) AS moran, (SELECT area FROM n) AS area FROM k""",
    # pairs with a circle through both that holds no other cell: the range of its centres on their bisector, in half distances
    "ends1": """SELECT *, (ax + bx) / 2 AS mx, (ay + b_y) / 2 AS my, (bx - ax) / 2 AS hx, (b_y - ay) / 2 AS hy FROM
      (SELECT a.cell_id AS a, b.cell_id AS b, a.X AS ax, a.Y AS ay, b.X AS bx, b.Y AS b_y FROM c1 a JOIN c1 b ON a.cell_id < b.cell_id)""",
    "room1": "SELECT e.a, e.b, (q.Y - my) * hx - (q.X - mx) * hy AS side, ((q.X - mx) * (q.X - mx) + (q.Y - my) * (q.Y - my) - hx * hx - hy * hy) / 2 AS room FROM ends1 e JOIN c1 q ON q.cell_id <> e.a AND q.cell_id <> e.b",
    "dl1": """SELECT e.*, lo, hi FROM ends1 e JOIN (SELECT a, b, coalesce(max(room / side) FILTER (WHERE side < 0), -1e300) AS lo, coalesce(min(room / side) FILTER (WHERE side > 0), 1e300) AS hi,
      min(room) FILTER (WHERE side = 0) AS line FROM room1 GROUP BY 1, 2) USING (a, b) WHERE lo <= hi AND coalesce(line, 0) >= 0""",
    "comp2": "SELECT cluster, celltype, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS total FROM c2 GROUP BY 1, 2",
    "qc2": "SELECT cell_id, sum(value) AS n_count, count(*) FILTER (WHERE value > 0) AS n_feature FROM e2 GROUP BY 1",
    "mom1": """SELECT o.*, (o.sx / o.n) AS mean, t.n - o.n AS m, (t.sx - o.sx) / (t.n - o.n) AS rest_mean FROM
      (SELECT celltype, feature, count(*) AS n, sum(value) AS sx, var_samp(value) AS v FROM e1 JOIN c1 USING (cell_id) GROUP BY 1, 2) o
      JOIN (SELECT feature, count(*) AS n, sum(value) AS sx FROM e1 JOIN c1 USING (cell_id) GROUP BY 1) t USING (feature)""",
    "rest1": "SELECT o.celltype, e.feature, var_samp(e.value) AS rv FROM typ1b o JOIN (SELECT * FROM e1 JOIN c1 USING (cell_id)) e ON e.celltype <> o.celltype GROUP BY 1, 2",
    "typ1b": "SELECT DISTINCT celltype FROM c1",
    "wel1": "SELECT m.celltype AS cluster, m.feature, m.n, mean, rest_mean, mean - rest_mean AS diff, v/n AS a, rv/m AS b, m FROM mom1 m JOIN rest1 USING (celltype, feature)",
    "pv": "SELECT concat('CL', (p_size % 4)::VARCHAR) AS cluster, p_partkey AS feature, ((p_partkey * 37) % 997 + 1) / 1000.0::DOUBLE AS p, ((p_partkey * 13) % 101 - 50) / 50.0::DOUBLE AS diff FROM part",
    "adjp": """SELECT cluster, feature, p, diff, least(1.0, min(p * m / rk) OVER (PARTITION BY cluster ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM
      (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, feature) AS rk, count(p) OVER (PARTITION BY cluster) AS m FROM pv)""",
}


def _r(c: str, n: int = 6, to: str | None = None):
    return F.round(F.col(c), n).alias(to or c)


def _edges1(spark, d):
    return W.edges_knn(V.small_cells(spark, d), 6)


def _p_values(spark, d) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat(F.lit("CL"), (F.col("p_size") % 4).cast("string")).alias("cluster"), F.col("p_partkey").alias("feature"), (((F.col("p_partkey") * 37) % 997 + 1) / 1000.0).alias("p"), (((F.col("p_partkey") * 13) % 101 - 50) / 50.0).alias("diff"))


# ---- flagship: cells -> graph -> neighbours' types
@_register(
    "knn_large",
    """SELECT id, nid, round(sqrt(d2), 6) AS dist, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS rn FROM
    (SELECT a.cell_id AS id, b.cell_id AS nid, (a.X-b.X)*(a.X-b.X)+(a.Y-b.Y)*(a.Y-b.Y) AS d2 FROM c2 a JOIN c2 b ON abs(a.X-b.X) <= 450 AND abs(a.Y-b.Y) <= 450 AND a.cell_id <> b.cell_id)) WHERE rn <= 10""",
)
def _(spark, d):
    return knn(points(V.large_cells(spark, d)), 10).select("id", "nid", F.round(F.sqrt("d2"), 6).alias("dist"), "rn")


@_register("prepare_cells", "SELECT cell_id AS \"Cell_ID\", X, Y, celltype, cluster FROM c2 WHERE isfinite(X) AND isfinite(Y) AND celltype IS NOT NULL")
def _(spark, d):
    return C.prepare_data(V.large_cells(spark, d), cell_id_col="cell_id").select("Cell_ID", "X", "Y", "celltype", "cluster")


def _qc(spark, d):
    return V.sparse_counts(spark, d).groupBy("cell_id").agg(F.sum("value").alias("n_count"), F.count_if(F.col("value") > 0).alias("n_feature"))


@_register(
    "filter_mad_quantile",
    """WITH s AS (SELECT median(n_count) AS med, mad(n_count) AS mad, quantile_cont(n_feature, 0.05) AS low FROM qc2)
    SELECT cell_id, n_count, n_feature FROM qc2, s WHERE abs(n_count - med) < 3 * mad AND n_feature > low""",
)
def _(spark, d):
    return C.filter_data(_qc(spark, d))


@_register("clr_by_cell", "SELECT cell_id, feature, round(ln(1 + value / exp(sum(CASE WHEN value > 0 THEN ln(1 + value) ELSE 0 END) OVER (PARTITION BY cell_id) / 200)), 6) AS value FROM e2")
def _(spark, d):
    return X.centred_log_ratio(V.sparse_counts(spark, d), "cell_id", 200).select("cell_id", "feature", _r("value"))


@_register("clr_by_feature", "SELECT cell_id, feature, round(ln(1 + value / exp(sum(CASE WHEN value > 0 THEN ln(1 + value) ELSE 0 END) OVER w / count(*) OVER w)), 6) AS value FROM e2 WINDOW w AS (PARTITION BY feature)")
def _(spark, d):
    return X.centred_log_ratio(V.sparse_counts(spark, d), "feature").select("cell_id", "feature", _r("value"))


@_register("clr_nonzero", "SELECT cell_id, feature, round(ln(1 + value / exp(avg(ln(1 + value)) FILTER (WHERE value > 0) OVER (PARTITION BY cell_id))), 6) AS value FROM e2")
def _(spark, d):
    return X.centred_log_ratio_nonzero(V.sparse_counts(spark, d)).select("cell_id", "feature", _r("value"))


@_register("log_normalize", "SELECT cell_id, feature, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000), 6) AS value FROM e2")
def _(spark, d):
    return X.log_normalise(V.sparse_counts(spark, d)).select("cell_id", "feature", _r("value"))


@_register("scale_features", "SELECT cell_id, feature, round(least(10, (value - avg(value) OVER w) / stddev_samp(value) OVER w), 6) AS value FROM e1 WINDOW w AS (PARTITION BY feature)")
def _(spark, d):
    return X.scale_features(V.dense_expression(spark, d)).select("cell_id", "feature", _r("value"))


@_register("densify", "SELECT c.cell_id, f.feature, coalesce(value, 0) AS value FROM c1 c CROSS JOIN (SELECT DISTINCT feature FROM e1) f LEFT JOIN (SELECT * FROM e1 WHERE value > 0) v USING (cell_id, feature)")
def _(spark, d):
    return X.densify(V.dense_expression(spark, d).where("value > 0"), V.small_cells(spark, d)).select("cell_id", "feature", "value")


@_register("elbow_total", "SELECT round(sum(v), 6) AS total FROM (SELECT feature, var_samp(value) AS v FROM e1 GROUP BY 1)")
def _(spark, d):
    values, _ = X.component_spectrum(V.dense_expression(spark, d), FEATURES)
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "total double")


@_register("elbow")
def _(spark, d):
    values, _ = X.component_spectrum(V.dense_expression(spark, d), FEATURES)
    return spark.createDataFrame([(i + 1, float(v) ** 0.5) for i, v in enumerate(values)], "pc int, stdev double")


@_register(
    "marker_statistics",
    """WITH j AS (SELECT * FROM e1 JOIN c1 USING (cell_id)), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM j),
    o AS (SELECT celltype AS cluster, feature, count(*) AS n, sum(rk) AS rs, count(*) FILTER (WHERE value > 0) AS p, sum(exp(value) - 1) AS s FROM r GROUP BY 1, 2),
    a AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE value > 0) AS p, sum(exp(value) - 1) AS s FROM r GROUP BY 1)
    SELECT cluster, o.feature, o.n::BIGINT AS n, round(log2(o.s / o.n + 1) - log2((a.s - o.s) / (a.n - o.n) + 1), 6) AS avg_log2fc, round(o.p / o.n, 6) AS pct_1, round((a.p - o.p) / (a.n - o.n), 6) AS pct_2, (rs - o.n * (o.n + 1) / 2.0)::DOUBLE AS u FROM o JOIN a USING (feature)""",
)
def _(spark, d):
    m = X.markers(V.dense_expression(spark, d), V.small_cells(spark, d), "celltype")
    return m.select("cluster", "feature", "n", _r("avg_log2fc"), _r("pct_1"), _r("pct_2"), "u")


def _top_markers_sql(values: str, threshold: float) -> str:
    """Rank sums with ties, the normal tail by the power series of its error function."""
    return f"""WITH j AS (SELECT v.*, celltype FROM ({values}) v JOIN c1 USING (cell_id)), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM j),
    o AS (SELECT celltype AS cluster, feature, count(*) AS n, sum(rk) AS rs, count(*) FILTER (WHERE value > 0) AS p, sum(exp(value) - 1) AS s FROM r GROUP BY 1, 2),
    i AS (SELECT feature, sum(c * c * c - c) AS tie FROM (SELECT feature, count(*)::DOUBLE AS c FROM r GROUP BY feature, value) GROUP BY 1),
    a AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE value > 0) AS p, sum(exp(value) - 1) AS s FROM r GROUP BY 1),
    f AS (SELECT cluster, feature, o.n::BIGINT AS n, (a.n - o.n)::BIGINT AS m, a.n::DOUBLE AS t, tie, log2(o.s / o.n + 1) - log2((a.s - o.s) / (a.n - o.n) + 1) AS fold, o.p / o.n AS pct_1, (a.p - o.p) / (a.n - o.n) AS pct_2, (rs - o.n * (o.n + 1) / 2.0)::DOUBLE AS u FROM o JOIN a USING (feature) JOIN i USING (feature)),
    h AS (SELECT *, u - n * m / 2.0 AS shift, sqrt(n::DOUBLE * m / 12 * (t + 1 - tie / (t * (t - 1)))) AS sigma FROM f),
    z AS (SELECT *, (shift - 0.5 * sign(shift)) / sigma AS z, abs(shift - 0.5 * sign(shift)) / sigma / sqrt(2) AS x FROM h WHERE fold >= {threshold} AND greatest(pct_1, pct_2) >= 0.25),
    e AS (SELECT *, CASE WHEN x > 6 THEN 0 WHEN x = 0 THEN 1 ELSE greatest(0, 1 - exp(-x * x) * list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5))))) END AS p,
      rank() OVER (PARTITION BY cluster ORDER BY fold DESC) AS place FROM z)
    SELECT cluster, feature, n, m, round(fold, 6) AS avg_log2fc, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, u, round(z, 6) AS z, round(p, 6) AS p, round(least(1, p * (SELECT count(*) FROM a)), 5) AS adj_p, place::INTEGER AS place FROM e WHERE place <= 5"""


def _rounded_markers(found):
    return found.select("cluster", "feature", "n", "m", _r("avg_log2fc"), _r("pct_1"), _r("pct_2"), "u", _r("z"), _r("p"), _r("adj_p", 5), "place")


@_register("top_markers", _top_markers_sql("SELECT * FROM e1", 0.0))
def _(spark, d):
    return _rounded_markers(X.top_markers(X.markers(V.dense_expression(spark, d), V.small_cells(spark, d), "celltype"), min_pct=0.25, threshold=0.0))


@_register("top_markers_scaled", _top_markers_sql("SELECT cell_id, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM e1 WINDOW w AS (PARTITION BY feature)", 0.25))
def _(spark, d):
    return _rounded_markers(X.top_markers(X.markers(X.scale_features(V.dense_expression(spark, d)), V.small_cells(spark, d), "celltype")))


@_register(
    "marker_mean_matrix",
    "WITH m AS (SELECT feature, celltype AS cluster, avg(value) AS mean FROM e1 JOIN c1 USING (cell_id) GROUP BY 1, 2) SELECT feature, cluster, round(mean, 6) AS mean, round((mean - avg(mean) OVER w) / stddev_samp(mean) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY feature)",
)
def _(spark, d):
    return X.marker_means(V.dense_expression(spark, d), V.small_cells(spark, d), "celltype").select("feature", "cluster", _r("mean"), _r("z"))


@_register("marker_violin", "SELECT feature, celltype AS cluster, count(value) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM e1 JOIN c1 USING (cell_id) WHERE feature IN ('prot2', 'prot5') GROUP BY 1, 2")
def _(spark, d):
    return X.marker_distribution(V.dense_expression(spark, d), V.small_cells(spark, d), ["prot2", "prot5"], "celltype").select("feature", "cluster", "n", *[_r(c) for c in ("low", "q1", "q2", "q3", "high")])


@_register("spatial_marker_panel", "SELECT cell_id, X, Y, feature, value FROM c1 JOIN e1 USING (cell_id) WHERE feature IN ('prot3', 'prot4')")
def _(spark, d):
    return X.marker_panel(V.small_cells(spark, d), V.dense_expression(spark, d), ["prot3", "prot4"])


@_register("annotate_celltypes", "SELECT cell_id, cluster, CASE cluster WHEN 'CN0' THEN 'a' WHEN 'CN1' THEN 'b' WHEN 'CN3' THEN 'c' END AS label FROM c2")
def _(spark, d):
    return C.annotate_celltypes(V.large_cells(spark, d), ["CN0", "CN1", "CN3", "CN0"], ["a", "b", "c", "z"], out="label").select("cell_id", "cluster", "label")


@_register("coordinate_coalesce", "SELECT cell_id, coalesce(CASE WHEN cell_id % 3 > 0 THEN X END, X) AS X, coalesce(CASE WHEN cell_id % 3 > 0 THEN Y END, Y) AS Y FROM c1")
def _(spark, d):
    cells = V.small_cells(spark, d)
    emb = cells.select("cell_id", F.array("X", "Y").alias("vec"))
    hole = lambda c: F.when(F.col("cell_id") % 3 > 0, F.col(c)).alias(c)
    return C.extract_coordinates(cells.select("cell_id", hole("X"), hole("Y")), emb).select("cell_id", "X", "Y")


@_register("knn_kth_distance", "SELECT id, round(sqrt(max(d2)), 6) AS d FROM nn1 WHERE rn <= 10 GROUP BY 1")
def _(spark, d):
    return kth_distance(knn(points(V.small_cells(spark, d)), 10), 10).select("id", _r("d"))


@_register("optimal_radius", "WITH k AS (SELECT id, sqrt(max(d2)) AS d FROM nn1 WHERE rn <= 10 GROUP BY 1) SELECT round(quantile_cont(d, 0.9) * 2, 6) AS recommended, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM k")
def _(spark, d):
    return W.optimal_radius(V.small_cells(spark, d)).select(_r("recommended"), _r("min_dist"), _r("max_dist"))


@_register("optimal_radius_pairwise", "WITH s AS (SELECT cell_id, X, Y FROM c1 WHERE X IS NOT NULL AND Y IS NOT NULL ORDER BY md5(concat(cell_id, ',123')), cell_id LIMIT 1000), p AS (SELECT sqrt((a.X-b.X)*(a.X-b.X)+(a.Y-b.Y)*(a.Y-b.Y)) AS d FROM s a JOIN s b ON a.cell_id < b.cell_id) SELECT round(avg(d), 6) AS mean_pairwise, count(*) AS pairs FROM p WHERE d > 0")
def _(spark, d):
    return W.optimal_radius(V.small_cells(spark, d)).select(_r("mean_pairwise"), "pairs")


@_register(
    "window_size",
    """WITH RECURSIVE e AS (SELECT count(*) AS n, min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM c2 WHERE X IS NOT NULL AND Y IS NOT NULL),
    s AS (SELECT 1 AS i, greatest(2, 2 * round_even(least(x1 - x0, y1 - y0) / 100 / 2, 0)) AS w FROM e UNION ALL
      SELECT i + 1, greatest(2, 2 * round_even(w * (CASE WHEN mean < 30 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END) / 2, 0)) FROM (SELECT *, n / ((floor(x1 / w) - floor(x0 / w) + 1) * (floor(y1 / w) - floor(y0 / w) + 1)) AS mean FROM s, e) WHERE mean NOT BETWEEN 30 AND 50 AND i <= 100),
    m AS (SELECT *, n / ((floor(x1 / w) - floor(x0 / w) + 1) * (floor(y1 / w) - floor(y0 / w) + 1)) AS mean FROM s, e),
    l AS (SELECT max_by(w, i) AS w, max_by(mean, i) FILTER (WHERE i <= 100) AS mean, max(i) AS i, any_value(x1 - x0) AS xr, any_value(y1 - y0) AS yr FROM m)
    SELECT w::INTEGER AS window_size, greatest(1, w::INTEGER // 2) AS sliding_step, round(mean, 6) AS mean_cells, round(xr, 6) AS x_range, round(yr, 6) AS y_range, mean BETWEEN 30 AND 50 AS converged FROM l""",
)
def _(spark, d):
    w = W.optimal_window_size(V.large_cells(spark, d))
    return spark.createDataFrame([(w.window_size, w.sliding_step, w.mean_cells and round(w.mean_cells, 6), round(w.x_range, 6), round(w.y_range, 6), w.converged)], "window_size int, sliding_step int, mean_cells double, x_range double, y_range double, converged boolean")


@_register("celltype_distance_matrix", "WITH m AS (SELECT id, t, nt, min(d2) AS d2 FROM pair1 GROUP BY 1, 2, 3) SELECT t AS source, nt AS target, round(avg(sqrt(d2)), 6) AS mean_dist, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, d):
    return H.celltype_distances(V.small_cells(spark, d)).select("source", "target", _r("mean_dist"), "n")


@_register("celltype_distance_lists", "SELECT t AS source, nt AS target, id, round(sqrt(min(d2)), 6) AS dist FROM pair1 GROUP BY 1, 2, 3")
def _(spark, d):
    return H.celltype_distance_lists(V.small_cells(spark, d)).withColumn("dist", F.round("dist", 6))


@_register("distance_heatmap_data", "WITH m AS (SELECT id, t, nt, min(d2) AS d2 FROM pair1 GROUP BY 1, 2, 3), a AS (SELECT t AS source, nt AS target, avg(sqrt(d2)) AS v FROM m GROUP BY 1, 2), s AS (SELECT median(v) AS mid, quantile_cont(v, 0.2) AS q2, quantile_cont(v, 0.9) AS q9 FROM a) SELECT source, target, round(v, 6) AS mean_dist, v < mid AS below_median, round(q2, 6) AS q20, round(q9, 6) AS q90 FROM a, s")
def _(spark, d):
    return H.distance_heat(H.celltype_distances(V.small_cells(spark, d))).select("source", "target", _r("mean_dist"), "below_median", F.round(F.col("stops")[1], 6).alias("q20"), F.round(F.col("stops")[5], 6).alias("q90"))


@_register("global_nn_stats", "WITH k AS (SELECT id, sqrt(d2) AS d FROM nn1 WHERE rn = 1) SELECT count(*) AS n, round(avg(d), 6) AS mean_dist, round(quantile_cont(d, 0.9), 6) AS q90, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM k")
def _(spark, d):
    return H.global_nn_stats(V.small_cells(spark, d)).select("n", *[_r(c) for c in ("mean_dist", "q90", "min_dist", "max_dist")])


@_register(
    "spatial_metrics",
    """WITH n AS (SELECT count(*) AS n, (max(X)-min(X)+1e-8)*(max(Y)-min(Y)+1e-8) AS area FROM c1), k AS (SELECT id, sqrt(max(d2)) AS d FROM nn1 WHERE rn <= 10 GROUP BY 1),
    f AS (SELECT avg(sqrt(d2)) AS m FROM nn1 WHERE rn = 1), g AS (SELECT 1 - sum(c * c) / (sum(c) * sum(c)) AS g FROM (SELECT count(*)::DOUBLE AS c FROM c1 GROUP BY celltype)),
    w AS (SELECT id, nt, (1 / (sqrt(d2) + 2.220446049250313e-16)) / sum(1 / (sqrt(d2) + 2.220446049250313e-16)) OVER (PARTITION BY id) AS w FROM nn1, n WHERE rn <= greatest(5, least(20, round_even(sqrt(n), 0)))),
    p AS (SELECT celltype AS t, count(*) / any_value(n.n) AS p FROM c1, n GROUP BY 1), s AS (SELECT id, nt, sum(w) AS s FROM w GROUP BY 1, 2),
    z AS (SELECT p.t, p.p, sum(((c1.celltype = p.t)::INT - p.p) * (coalesce(s.s, 0) - p.p)) / (any_value(n.n) * p.p * (1 - p.p)) AS i FROM c1 CROSS JOIN p CROSS JOIN n LEFT JOIN s ON s.id = c1.cell_id AND s.nt = p.t GROUP BY 1, 2)
    SELECT (SELECT n FROM n) AS n, round(avg(d), 6) AS mean_nn, round(stddev_samp(d) / avg(d), 6) AS cv_nn, round((SELECT m / (0.5 / sqrt(n / area)) FROM f, n), 6) AS clark_evans, round((SELECT g FROM g), 6) AS gini_simpson, round((SELECT sum(p * i) / sum(p) FROM z), 6) AS moran FROM k""",
)
def _(spark, d):
    cells = V.small_cells(spark, d)
    nn = knn(points(cells), max(W.DEFAULT_RANK, W.moran_neighbours(cells.count())))
    return W.metrics_frame(cells, nn).select("n", *[_r(c) for c in ("mean_nn", "cv_nn", "clark_evans", "gini_simpson", "moran")])


@_register("edges_knn", "SELECT e.a AS \"from\", e.b AS \"to\", round(dist, 6) AS dist, x.celltype AS from_type, y.celltype AS to_type, x.celltype = y.celltype AS same_type FROM edge1 e JOIN c1 x ON x.cell_id = e.a JOIN c1 y ON y.cell_id = e.b")
def _(spark, d):
    return W.with_types(_edges1(spark, d), V.small_cells(spark, d)).withColumn("dist", F.round("dist", 6))


@_register("edges_radius_capped", f"WITH n AS (SELECT greatest(5, least(50, round_even(count(*) / ((max(X)-min(X)+1e-8)*(max(Y)-min(Y)+1e-8)) * pi() * {RADIUS} * {RADIUS}, 0))) AS deg FROM c1) SELECT least(id,nid) AS \"from\", greatest(id,nid) AS \"to\", round(sqrt(min(d2)), 6) AS dist FROM nn1, n WHERE rn <= deg AND d2 <= {RADIUS} * {RADIUS} GROUP BY 1, 2")
def _(spark, d):
    return W.edges_radius(V.small_cells(spark, d), RADIUS).withColumn("dist", F.round("dist", 6))


@_register("edges_radius_full", f"SELECT least(id,nid) AS \"from\", greatest(id,nid) AS \"to\", round(sqrt(min(d2)), 6) AS dist FROM pair1 WHERE d2 <= {RADIUS} * {RADIUS} GROUP BY 1, 2")
def _(spark, d):
    return W.edges_radius(V.small_cells(spark, d), RADIUS, None).withColumn("dist", F.round("dist", 6))


@_register(
    "edges_window",
    """WITH t AS (SELECT *, floor(X / 60) AS gx, floor(Y / 60) AS gy FROM c2), b AS (SELECT DISTINCT gx, gy FROM t),
    m AS (SELECT b.gx AS bx, b.gy AS b_y, t.* FROM b JOIN t ON t.gx BETWEEN b.gx - 1 AND b.gx + 1 AND t.gy BETWEEN b.gy - 1 AND b.gy + 1),
    p AS (SELECT a.bx, a.b_y, a.cell_id AS id, o.cell_id AS nid, (a.X-o.X)*(a.X-o.X)+(a.Y-o.Y)*(a.Y-o.Y) AS d2 FROM m a JOIN m o ON a.bx = o.bx AND a.b_y = o.b_y AND a.cell_id <> o.cell_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY bx, b_y, id ORDER BY d2, nid) AS rn FROM p)
    SELECT least(id,nid) AS "from", greatest(id,nid) AS "to", round(sqrt(min(d2)), 6) AS dist FROM r WHERE rn <= 6 GROUP BY 1, 2""",
)
def _(spark, d):
    return W.edges_window(V.large_cells(spark, d), 6, 60.0).withColumn("dist", F.round("dist", 6))


@_register(
    "network_auto",
    # one branch for each method that up to 50 000 cells can get
    """WITH m AS (SELECT *, greatest(4, least(30, round_even(8 + 4 * log10(greatest(10, n)), 0))) AS k FROM met1),
    c AS (SELECT *, CASE WHEN moran >= 0.4 THEN 'radius' WHEN cv_nn < 0.3 AND clark_evans BETWEEN 0.95 AND 1.05 THEN 'knn' WHEN cv_nn < 0.3 AND clark_evans BETWEEN 0.85 AND 1.15 THEN 'radius' ELSE 'delaunay' END AS method FROM m),
    r AS (SELECT *, greatest(5, least(greatest(20, 3 * k), round_even(n / area * pi() * 4 * mean_nn * mean_nn, 0))) AS cap FROM c),
    e AS (SELECT a, b, 2 * sqrt(hx * hx + hy * hy) AS dist FROM dl1, r WHERE method = 'delaunay' AND 2 * sqrt(hx * hx + hy * hy) <= 2 * mean_nn
      UNION ALL SELECT least(id, nid), greatest(id, nid), sqrt(min(d2)) FROM nn1, r WHERE method = 'knn' AND rn <= k OR method = 'radius' AND rn <= cap AND d2 <= 4 * mean_nn * mean_nn GROUP BY 1, 2)
    SELECT e.a AS "from", e.b AS "to", round(dist, 6) AS dist, x.celltype AS from_type, y.celltype AS to_type, x.celltype = y.celltype AS same_type FROM e JOIN c1 x ON x.cell_id = e.a JOIN c1 y ON y.cell_id = e.b""",
)
def _(spark, d):
    return W.build_spatial_network(V.small_cells(spark, d)).edges.withColumn("dist", F.round("dist", 6))


@_register("edge_cap", "SELECT a AS \"from\", b AS \"to\", round(dist, 6) AS dist FROM edge1 ORDER BY -ln((('0x' || left(md5(concat(a, ',', b, ',42')), 13))::BIGINT + 1) / 4503599627370496) * (dist + 2.220446049250313e-16), 1, 2 LIMIT 200")
def _(spark, d):
    return W.cap_edges(_edges1(spark, d), 200).select("from", "to", _r("dist"))


@_register("edges_delaunay_all", "SELECT a AS \"from\", b AS \"to\", 2 * sqrt(hx * hx + hy * hy) AS dist FROM dl1")
def _(spark, d):
    return G.edges_delaunay(V.small_cells(spark, d))


@_register("voronoi_area", "SELECT round((max(X) - min(X)) * (max(Y) - min(Y)), 3) AS area FROM c1")
def _(spark, d):
    return G.voronoi_areas(G.voronoi(V.small_cells(spark, d))).agg(F.round(F.sum("area"), 3).alias("area"))


@_register(
    "voronoi_cells",
    # triangles from a cell to its parts of bisectors and of the box's sides
    """WITH x AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM c1),
    i AS (SELECT a, b, hx * hx + hy * hy AS hh, greatest(lo, least((mx - x0) / nullif(hy, 0), (mx - x1) / nullif(hy, 0)), least((y0 - my) / nullif(hx, 0), (y1 - my) / nullif(hx, 0))) AS lo,
      least(hi, greatest((mx - x0) / nullif(hy, 0), (mx - x1) / nullif(hy, 0)), greatest((y0 - my) / nullif(hx, 0), (y1 - my) / nullif(hx, 0))) AS hi FROM dl1, x),
    s AS (SELECT cell_id, X, Y, X - x0 AS far, x0 AS sx, y0 AS sy, 0 AS ex, y1 - y0 AS ey FROM c1, x UNION ALL SELECT cell_id, X, Y, x1 - X, x1, y0, 0, y1 - y0 FROM c1, x
      UNION ALL SELECT cell_id, X, Y, Y - y0, x0, y0, x1 - x0, 0 FROM c1, x UNION ALL SELECT cell_id, X, Y, y1 - Y, x0, y1, x1 - x0, 0 FROM c1, x),
    h AS (SELECT s.cell_id, far, sx, sy, ex + ey AS len, (o.X - s.X) * ex + (o.Y - s.Y) * ey AS slope, ((o.X - s.X) * ((o.X + s.X) / 2 - sx) + (o.Y - s.Y) * ((o.Y + s.Y) / 2 - sy)) AS room FROM s JOIN c1 o ON o.cell_id <> s.cell_id),
    g AS (SELECT cell_id, far, len, greatest(0, max(CASE WHEN slope < 0 THEN room / slope END)) AS lo, least(1, min(CASE WHEN slope > 0 THEN room / slope END)) AS hi FROM h GROUP BY cell_id, far, len, sx, sy),
    p AS (SELECT a AS cell_id, hh * (hi - lo) / 2 AS part FROM i WHERE hi > lo UNION ALL SELECT b, hh * (hi - lo) / 2 FROM i WHERE hi > lo UNION ALL SELECT cell_id, far * len * (hi - lo) / 2 FROM g WHERE hi > lo)
    SELECT cell_id, round(sum(part), 4) AS area FROM p GROUP BY 1""",
)
def _(spark, d):
    return G.voronoi_areas(G.voronoi(V.small_cells(spark, d))).select("cell_id", _r("area", 4))


@_register("voronoi_highlight", "SELECT cell_id, CASE WHEN celltype IN ('T1', 'T4') THEN celltype ELSE 'Background' END AS category, celltype IN ('T1', 'T4') AS highlighted FROM c1")
def _(spark, d):
    cells = V.small_cells(spark, d)
    return G.voronoi_plot(G.voronoi(cells), cells, highlight=("celltype", ["T1", "T4"])).select("cell_id", "category", "highlighted").distinct()


@_register("voronoi_limits", "SELECT round(min(X) - 0.05 * (max(X) - min(X)), 6) AS x_low, round(max(X) + 0.05 * (max(X) - min(X)), 6) AS x_high, round(min(Y) - 0.05 * (max(Y) - min(Y)), 6) AS y_low, round(max(Y) + 0.05 * (max(Y) - min(Y)), 6) AS y_high FROM c1")
def _(spark, d):
    return G.plot_limits(G.voronoi(V.small_cells(spark, d))).select(*[_r(c) for c in ("x_low", "x_high", "y_low", "y_high")])


@_register("nbr_features_long", "WITH q AS (SELECT a.id, c1.celltype AS nbr_type, count(*) AS c FROM adj1 a JOIN c1 ON c1.cell_id = a.nid GROUP BY 1, 2) SELECT id, nbr_type, round(c / sum(c) OVER (PARTITION BY id), 6) AS prop FROM q")
def _(spark, d):
    return H.neighbourhood_features_long(V.small_cells(spark, d), _edges1(spark, d)).select("id", "nbr_type", _r("prop"))


@_register(
    "nbr_features_wide",
    "WITH q AS (SELECT a.id, " + ", ".join(f"avg((c.celltype = '{t}')::INT) AS p{i}" for i, t in enumerate(TYPES_1)) + ", avg(c.X) AS cx, avg(c.Y) AS cy FROM adj1 a JOIN c1 c ON c.cell_id = a.nid GROUP BY 1) SELECT c.cell_id, "
    + ", ".join(f"round(coalesce(p{i}, 0), 6) AS \"Nbr_{t}\"" for i, t in enumerate(TYPES_1)) + ", round(coalesce(cx, 0), 6) AS \"Centroid_X\", round(coalesce(cy, 0), 6) AS \"Centroid_Y\", round(coalesce(cx, 0) - X, 6) AS \"Rel_X\", round(coalesce(cy, 0) - Y, 6) AS \"Rel_Y\" FROM c1 c LEFT JOIN q ON q.id = c.cell_id",
)
def _(spark, d):
    f = H.neighbourhood_features(V.small_cells(spark, d), _edges1(spark, d), TYPES_1)
    return f.select("cell_id", *[_r(c) for c in f.columns if c.startswith(("Nbr_", "Centroid_", "Rel_"))])


def _purity_sql(near: str, least: int) -> str:
    return f"WITH q AS (SELECT id, nt, count(*) AS c FROM ({near}) GROUP BY 1, 2), s AS (SELECT id, sum(c) AS n, max(c) AS m FROM q GROUP BY 1) SELECT c.cell_id, coalesce(n, 0)::BIGINT AS neighbours, round(CASE WHEN n >= {least} THEN m / n END, 6) AS purity FROM c1 c LEFT JOIN s ON s.id = c.cell_id"


@_register("purity_window", _purity_sql("SELECT a.cell_id AS id, b.celltype AS nt FROM c1 a JOIN c1 b ON a.cell_id <> b.cell_id AND abs(a.X-b.X) <= 60 AND abs(a.Y-b.Y) <= 60", 5))
def _(spark, d):
    return H.purity(V.small_cells(spark, d), "window", radius=120.0).withColumn("purity", F.round("purity", 6))


@_register("purity_radius", _purity_sql("SELECT * FROM pair1 WHERE d2 > 0 AND d2 <= 80 * 80", 5))
def _(spark, d):
    return H.purity(V.small_cells(spark, d), "radius", radius=80.0).withColumn("purity", F.round("purity", 6))


@_register("purity_knn", _purity_sql("SELECT * FROM nn1 WHERE rn <= 30", 5))
def _(spark, d):
    return H.purity(V.small_cells(spark, d), "knn", k=30).withColumn("purity", F.round("purity", 6))


@_register("purity_delaunay", _purity_sql("SELECT d.id, celltype AS nt FROM (SELECT a AS id, b AS nid FROM dl1 UNION ALL SELECT b, a FROM dl1) d JOIN c1 ON c1.cell_id = d.nid", 3))
def _(spark, d):
    return H.purity(V.small_cells(spark, d), "delaunay", min_cells=3).withColumn("purity", F.round("purity", 6))


@_register("purity_radius_large", "WITH p AS (SELECT a.cell_id AS id, b.celltype AS nt FROM c2 a JOIN c2 b ON a.cell_id <> b.cell_id AND abs(a.X-b.X) <= 40 AND abs(a.Y-b.Y) <= 40 AND (a.X-b.X)*(a.X-b.X)+(a.Y-b.Y)*(a.Y-b.Y) BETWEEN 1e-300 AND 1600), q AS (SELECT id, nt, count(*) AS c FROM p GROUP BY 1, 2), s AS (SELECT id, sum(c) AS n, max(c) AS m FROM q GROUP BY 1) SELECT c.cell_id, coalesce(n, 0)::BIGINT AS neighbours, round(CASE WHEN n >= 5 THEN m / n END, 6) AS purity FROM c2 c LEFT JOIN s ON s.id = c.cell_id")
def _(spark, d):
    return H.purity(V.large_cells(spark, d), "radius", radius=40.0).withColumn("purity", F.round("purity", 6))


_MATRIX = "WITH e AS (SELECT least(x.celltype, y.celltype) AS a, greatest(x.celltype, y.celltype) AS b FROM edge1 JOIN c1 x ON x.cell_id = edge1.a JOIN c1 y ON y.cell_id = edge1.b), m AS (SELECT a AS type1, b AS type2, count(*) * (CASE WHEN a = b THEN 2 ELSE 1 END) AS n FROM e GROUP BY a, b UNION ALL SELECT b, a, count(*) FROM e WHERE a <> b GROUP BY a, b), u AS (SELECT a AS t FROM e UNION SELECT b FROM e), f AS (SELECT p.t AS type1, q.t AS type2, coalesce(m.n, 0)::BIGINT AS n FROM u p CROSS JOIN u q LEFT JOIN m ON m.type1 = p.t AND m.type2 = q.t) "


@_register("interaction_matrix", _MATRIX + "SELECT * FROM f")
def _(spark, d):
    return H.interactions(V.small_cells(spark, d), _edges1(spark, d)).select("type1", "type2", F.col("n").cast("long").alias("n"))


@_register("interaction_heatmap", _MATRIX + "SELECT type1, type2, n, round(log2(n + 1), 6) AS value FROM f")
def _(spark, d):
    return H.interaction_heat(H.interactions(V.small_cells(spark, d), _edges1(spark, d))).select("type1", "type2", F.col("n").cast("long").alias("n"), _r("value"))


@_register("interaction_node_strength", _MATRIX + "SELECT type1 AS type, count(*) FILTER (WHERE n > 0) AS degree, sum(n)::BIGINT AS strength FROM f GROUP BY 1 ORDER BY strength DESC, type LIMIT 5")
def _(spark, d):
    return H.interaction_nodes(H.interactions(V.small_cells(spark, d), _edges1(spark, d)), 5).select("type", "degree", F.col("strength").cast("long").alias("strength"))


@_register("interaction_subgraph", _MATRIX + ", g AS (SELECT type1 AS type FROM f GROUP BY 1 ORDER BY sum(n) DESC, type1 LIMIT 5) SELECT type1, type2, n FROM f WHERE n > 0 AND type1 <= type2 AND type1 IN (SELECT type FROM g) AND type2 IN (SELECT type FROM g)")
def _(spark, d):
    return H.interaction_subgraph(H.interactions(V.small_cells(spark, d), _edges1(spark, d)), 5).select("type1", "type2", F.col("n").cast("long").alias("n"))


@_register("cluster_composition", "SELECT cluster, celltype, n AS count, total::BIGINT AS total, round(n / total, 6) AS proportion FROM comp2")
def _(spark, d):
    return C.cluster_composition(V.large_cells(spark, d)).withColumn("proportion", F.round("proportion", 6))


@_register("composition_zscore", "WITH k AS (SELECT DISTINCT cluster FROM c2), t AS (SELECT DISTINCT celltype FROM c2), g AS (SELECT cluster, celltype, coalesce(n / total, 0) AS value FROM k CROSS JOIN t LEFT JOIN comp2 USING (cluster, celltype)) SELECT cluster, celltype, round(value, 6) AS value, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 5) AS z FROM g WINDOW w AS (PARTITION BY cluster)")
def _(spark, d):
    return C.composition_z(C.cluster_composition(V.large_cells(spark, d)), TYPES_2).select("cluster", "celltype", _r("value"), _r("z", 5))


@_register("composition_bars", "WITH t AS (SELECT celltype, sum(n) AS type_total FROM comp2 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY type_total DESC, celltype) AS place FROM t) SELECT cluster, celltype, round((n / total) / sum(n / total) OVER (PARTITION BY cluster), 6) AS share, type_total::BIGINT AS type_total, place::INTEGER AS place FROM comp2 JOIN o USING (celltype)")
def _(spark, d):
    return C.composition_bars(C.cluster_composition(V.large_cells(spark, d))).withColumn("share", F.round("share", 6))


@_register("network_segments_top", "SELECT e.a AS \"from\", e.b AS \"to\", x.X AS x1, x.Y AS y1, y.X AS x2, y.Y AS y2, round(1 / dist, 6) AS strength FROM edge1 e JOIN c1 x ON x.cell_id = e.a JOIN c1 y ON y.cell_id = e.b ORDER BY 1 / dist DESC, 1, 2 LIMIT 100")
def _(spark, d):
    return H.network_segments(V.small_cells(spark, d), _edges1(spark, d), "top", 100).select("from", "to", "x1", "y1", "x2", "y2", _r("strength"))


_SEGMENTS = "SELECT e.a AS \"from\", e.b AS \"to\", x.X AS x1, x.Y AS y1, y.X AS x2, y.Y AS y2, round(1 / dist, 6) AS strength FROM edge1 e JOIN c1 x ON x.cell_id = e.a JOIN c1 y ON y.cell_id = e.b"


@_register("network_segments_all", _SEGMENTS)
def _(spark, d):
    return H.network_segments(V.small_cells(spark, d), _edges1(spark, d)).select("from", "to", "x1", "y1", "x2", "y2", _r("strength"))


@_register("network_segments_random", _SEGMENTS + " ORDER BY md5(concat(e.a, ',', e.b, ',42')), 1, 2 LIMIT 100")
def _(spark, d):
    return H.network_segments(V.small_cells(spark, d), _edges1(spark, d), "random", max_edges=100).select("from", "to", "x1", "y1", "x2", "y2", _r("strength"))


@_register("plot_sample", "SELECT * FROM c2 ORDER BY md5(concat(cell_id, ',42')), cell_id LIMIT 1000")
def _(spark, d):
    return H.plot_sample(V.large_cells(spark, d), 1000)


def _merge_protein(spark, d, expression):
    cl = V.small_cells(spark, d).select(F.concat(F.lit("Cell_"), F.col("cell_id").cast("string")).alias("Cell_ID"), "X", "Y", F.col("celltype").alias("Neighborhood_Cluster"))
    wide = expression.groupBy(F.col("cell_id").alias("Cell_ID")).pivot("feature", ["prot2", "prot3"]).agg(F.max("value"))
    return X.merge_protein(cl, wide.withColumnRenamed("prot2", "p2").withColumnRenamed("prot3", "p3")).select("Cell_ID", "X", "Y", "Neighborhood_Cluster", "p2", "p3", "Spatial_Zone")


@_register("merge_protein_all", "SELECT c.cell_id::VARCHAR AS \"Cell_ID\", X, Y, celltype AS \"Neighborhood_Cluster\", p2, p3, celltype AS \"Spatial_Zone\" FROM c1 c LEFT JOIN (SELECT cell_id, max(value) FILTER (WHERE feature = 'prot2') AS p2, max(value) FILTER (WHERE feature = 'prot3') AS p3 FROM e1 GROUP BY 1) e USING (cell_id)")
def _(spark, d):
    return _merge_protein(spark, d, V.dense_expression(spark, d))


@_register("de_welch_t_df", "SELECT cluster, feature, n, round(mean, 6) AS mean, round(rest_mean, 6) AS rest_mean, round(diff, 6) AS mean_diff, round(diff / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)), 4) AS df FROM wel1")
def _(spark, d):
    w = X.welch(X.cluster_moments(V.dense_expression(spark, d), V.small_cells(spark, d), "celltype"))
    return w.select("cluster", "feature", "n", _r("mean"), _r("rest_mean"), _r("mean_diff"), _r("t"), _r("df", 4))


@_register(
    "differential_expression",
    # the tail of t by the power series of the incomplete beta function at t * t / (df + t * t)
    """WITH s AS (SELECT *, diff * diff / (a + b) AS t2, (a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)) AS df FROM wel1), y AS (SELECT *, t2 / (df + t2) AS y, df / 2 AS h FROM s),
    p AS (SELECT *, CASE WHEN y = 0 THEN 1 ELSE greatest(0, 1 - 2 * list_sum(list_transform(range(2000), lambda k: exp((k + 0.5) * ln(y) + h * ln(1 - y) + lgamma(0.5 + h + k) - lgamma(h) - lgamma(0.5) + lgamma(1.5) - lgamma(1.5 + k))))) END AS p FROM y),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, feature) AS rk, count(*) OVER (PARTITION BY cluster) AS c FROM p),
    q AS (SELECT *, least(1.0, min(p * c / rk) OVER (PARTITION BY cluster ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
    SELECT feature AS "Protein", cluster AS "Cluster", round(mean, 6) AS "Mean_Target", round(rest_mean, 6) AS "Mean_Control", round(diff, 6) AS "MeanDiff", round(p, 6) AS p_value, round(adj, 6) AS adj_p_value, CASE WHEN adj >= 0.05 THEN 'NS' WHEN diff > 0 THEN 'Up' ELSE 'Down' END AS "Significance" FROM q""",
)
def _(spark, d):
    found = X.differential_expression(V.dense_expression(spark, d), V.small_cells(spark, d), "celltype")
    return found.select("Protein", "Cluster", *[_r(c) for c in ("Mean_Target", "Mean_Control", "MeanDiff", "p_value", "adj_p_value")], "Significance")


@_register("bh_adjust", "SELECT cluster, feature, round(p, 6) AS p, round(adj, 9) AS adj FROM adjp")
def _(spark, d):
    from ..functions.stats import benjamini_hochberg

    return benjamini_hochberg(_p_values(spark, d), "p", ["cluster"], ["feature"], "adj").select("cluster", "feature", _r("p"), _r("adj", 9))


def _as_diff(spark, d):
    return _p_values(spark, d).select(F.concat(F.lit("prot"), (F.col("feature") % 200).cast("string")).alias("Protein"), F.col("cluster").alias("Cluster"), F.col("diff").alias("MeanDiff"), F.col("p").alias("p_value"), F.col("p").alias("adj_p_value"))


@_register("volcano_classes", "SELECT concat('prot', (feature % 200)::VARCHAR) AS \"Protein\", cluster AS \"Cluster\", round(diff, 6) AS \"MeanDiff\", CASE WHEN p < 0.05 AND diff >= 0.25 THEN 'Up' WHEN p < 0.05 AND diff <= -0.25 THEN 'Down' ELSE 'NS' END AS \"Significance\", round(-log10(p), 6) AS neg_log10_p FROM pv")
def _(spark, d):
    return X.volcano(_as_diff(spark, d)).select("Protein", "Cluster", _r("MeanDiff"), "Significance", _r("neg_log10_p"))


_OVER = """WITH s AS (SELECT DISTINCT cluster, concat('prot', (feature % 200)::VARCHAR) AS gene FROM pv WHERE p < 0.3 AND abs(diff) > 0), q AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS c FROM s),
    u AS (SELECT database, count(DISTINCT gene) AS universe FROM gset GROUP BY 1), z AS (SELECT database, term, count(*) AS size FROM gset GROUP BY 1, 2),
    i AS (SELECT cluster, database, count(*) AS query FROM (SELECT DISTINCT database, gene FROM gset) JOIN q USING (gene) WHERE c >= 2 GROUP BY 1, 2),
    o AS (SELECT cluster, database, term, count(*) AS k FROM q JOIN gset USING (gene) WHERE c >= 2 GROUP BY 1, 2, 3),
    a AS (SELECT * FROM o JOIN z USING (database, term) JOIN i USING (cluster, database) JOIN u USING (database)) """


@_register("enrich_overlap", _OVER + "SELECT cluster AS \"Cluster\", database AS \"Database\", term AS \"Term\", k, size, query, universe FROM a")
def _(spark, d):
    return N.overlaps(N.significant_genes(_as_diff(spark, d), p_cutoff=0.3), V.gene_sets(spark, d))


@_register(
    "enrich_p",
    _OVER + """, j AS (SELECT *, unnest(range(greatest(k, query + size - universe), least(size, query) + 1)) AS x FROM a)
    SELECT cluster AS "Cluster", database AS "Database", term AS "Term", k, round(least(1, sum(exp(lgamma(size+1)-lgamma(x+1)-lgamma(size-x+1) + lgamma(universe-size+1)-lgamma(query-x+1)-lgamma(universe-size-query+x+1) - lgamma(universe+1)+lgamma(query+1)+lgamma(universe-query+1)))), 6) AS p_value FROM j GROUP BY 1, 2, 3, 4""",
)
def _(spark, d):
    from ..functions.stats import hypergeometric_p

    found = N.overlaps(N.significant_genes(_as_diff(spark, d), p_cutoff=0.3), V.gene_sets(spark, d))
    return found.select("Cluster", "Database", "Term", "k", F.round(hypergeometric_p("k", "size", "query", "universe"), 6).alias("p_value"))


@_register(
    "enrich_terms",
    _OVER + """, j AS (SELECT *, unnest(range(greatest(k, query + size - universe), least(size, query) + 1)) AS x FROM a),
    h AS (SELECT cluster, database, term, k, size, query, universe, least(1, sum(exp(lgamma(size+1)-lgamma(x+1)-lgamma(size-x+1) + lgamma(universe-size+1)-lgamma(query-x+1)-lgamma(universe-size-query+x+1) - lgamma(universe+1)+lgamma(query+1)+lgamma(universe-query+1)))) AS p FROM j GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY cluster, database ORDER BY p, term) AS rk, count(*) OVER (PARTITION BY cluster, database) AS m FROM h),
    v AS (SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY cluster, database ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM w)
    SELECT cluster AS "Cluster", database AS "Database", term AS "Term", k, size, query, universe, round(p, 6) AS p_value, round(fdr, 6) AS "FDR", concat(k, '/', size) AS "Overlap", size AS "GenesN" FROM v WHERE fdr < 0.3""",
)
def _(spark, d):
    found = N.cluster_enrichment(_as_diff(spark, d), V.gene_sets(spark, d), databases=["DB0", "DB1"], p_cutoff=0.3)
    return found.withColumn("p_value", F.round("p_value", 6)).withColumn("FDR", F.round("FDR", 6))


@_register("enrich_top_terms", "WITH e AS (SELECT cluster, concat('term ', feature::VARCHAR, ' with a rather long name indeed (GO:', feature::VARCHAR, ')') AS term, p AS fdr FROM pv), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY fdr, term) AS place FROM e WHERE fdr < 0.05), l AS (SELECT *, regexp_replace(term, ' \\(.*', '') AS s FROM r WHERE place <= 5) SELECT cluster AS \"Cluster\", term AS \"Term\", CASE WHEN length(s) > 40 THEN concat(left(s, 37), '...') ELSE s END AS label, round(-log10(fdr), 6) AS \"log10FDR\", place::INTEGER AS place FROM l")
def _(spark, d):
    p = _p_values(spark, d)
    name = F.concat(F.lit("term "), F.col("feature").cast("string"), F.lit(" with a rather long name indeed (GO:"), F.col("feature").cast("string"), F.lit(")"))
    return N.top_terms(p.select(F.col("cluster").alias("Cluster"), name.alias("Term"), F.col("p").alias("FDR"))).select("Cluster", "Term", "label", _r("log10FDR"), "place")


@_register("snn_graph", "WITH l AS (SELECT id, nid FROM nn1 WHERE rn < 10 UNION SELECT cell_id, cell_id FROM c1), s AS (SELECT a.id AS x, b.id AS y, count(*) AS s FROM l a JOIN l b ON a.nid = b.nid AND a.id < b.id GROUP BY 1, 2) SELECT x AS \"from\", y AS \"to\", round(s / (20 - s), 6) AS weight FROM s WHERE s / (20 - s) >= 1.0 / 15")
def _(spark, d):
    return K.snn_graph(knn(points(V.small_cells(spark, d)), 10), 10).select("from", "to", _r("weight"))


def _features(spark, d):
    cells = V.small_cells(spark, d)
    return H.neighbourhood_features(cells, _edges1(spark, d), TYPES_1)


@_register("kmeans_neighborhoods")
def _(spark, d):
    return K.cluster_neighborhoods(_features(spark, d), method="kmeans", k=5).select("cell_id", "Neighborhood_Cluster")


@_register("hdbscan_neighborhoods")
def _(spark, d):
    return K.cluster_neighborhoods(_features(spark, d), method="hdbscan").select("cell_id", "Neighborhood_Cluster")


@_register("louvain_neighborhoods")
def _(spark, d):
    return K.cluster_neighborhoods(V.small_cells(spark, d), _edges1(spark, d), method="louvain").select("cell_id", "Neighborhood_Cluster")


@_register("louvain_modularity")
def _(spark, d):
    e = _edges1(spark, d)
    return K.modularity(e, K.graph_clusters(e))


@_register("expression_clusters")
def _(spark, d):
    e = X.scale_features(V.dense_expression(spark, d))
    _, vectors = X.component_spectrum(e, FEATURES, 5)
    return K.expression_clusters(X.component_scores(e, FEATURES, vectors))


@_register("process_clusters")
def _(spark, d):
    from ..operators.process import process_data

    return process_data(V.dense_expression(spark, d).withColumn("value", F.abs("value")), FEATURES).clusters


@_register("process_layout")
def _(spark, d):
    from ..operators.process import plane_points, process_data

    done = process_data(V.dense_expression(spark, d).withColumn("value", F.abs("value")), FEATURES)
    return plane_points(done.layout, done.clusters)


@_register("spatial_scatter", "SELECT cell_id AS id, X AS x, Y AS y, cluster AS category FROM c2")
def _(spark, d):
    from ..operators.process import spatial_scatter

    return spatial_scatter(V.large_cells(spark, d), "cluster")
