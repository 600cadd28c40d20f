"""Spatial statistics and neighbourhood graphs."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import exact_quantiles
from ..plans.storage import keep
from .local import nearest
from .neighbours import extent, knn, kth_distance, points, range_join, range_pairs

EPS = 2.220446049250313e-16
DEFAULT_RANK = 10


@dataclass
class SpatialMetrics:
    n: int
    mean_nn: float | None
    cv_nn: float | None
    clark_evans: float | None
    gini_simpson: float | None
    moran: float | None
    area: float


@dataclass
class NetworkResult:
    edges: DataFrame
    metrics: SpatialMetrics | None
    method: str
    params: dict = field(default_factory=dict)


def moran_neighbours(n: int) -> int:
    return max(5, min(20, round(math.sqrt(n))))


def default_k(n: int) -> int:
    return max(4, min(30, round(8 + 4 * math.log10(max(10, n)))))


def categorical_moran(nn: DataFrame, typed: DataFrame, k: int) -> DataFrame:
    """One row ``moran``: mean of the types' Moran's I by inverse-distance weights, weighted by share. ``typed`` is (id, celltype)."""
    w = 1.0 / (F.sqrt("d2") + EPS)
    near = nn.where(F.col("rn") <= k).withColumn("w", w).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("id")))
    to = typed.select(F.col("id").alias("nid"), F.col("celltype").alias("t"))
    share = near.join(to, "nid").groupBy("id", "t").agg(F.sum("w").alias("s"))
    totals = typed.groupBy(F.col("celltype").alias("t")).agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy()))
    # sum over cells of (z - p)(s - p): cells without a neighbour of the type have s = 0
    own = share.join(typed.select("id", "celltype"), "id").groupBy("t").agg(F.sum(F.when(F.col("celltype") == F.col("t"), F.col("s")).otherwise(0.0)).alias("zs"), F.sum("s").alias("s"))
    each = totals.join(own, "t", "left").withColumn("p", F.col("c") / F.col("n"))
    cross = F.coalesce("zs", F.lit(0.0)) - F.col("p") * F.col("c") - F.col("p") * F.coalesce("s", F.lit(0.0)) + F.col("n") * F.col("p") * F.col("p")
    down = F.col("n") * F.col("p") * (1 - F.col("p"))
    each = each.withColumn("i", F.try_divide(cross, F.when(down >= EPS, down)))
    return each.where("i IS NOT NULL").agg(F.try_divide(F.sum(F.col("p") * F.col("i")), F.sum("p")).alias("moran"))


def metrics_frame(cells: DataFrame, nn: DataFrame, celltype_col: str = "celltype") -> DataFrame:
    """One row with all metrics; ``nn`` has at least the default rank and Moran's number of neighbours."""
    p = points(cells)
    box = p.agg(F.count("*").alias("n"), ((F.max("x") - F.min("x") + 1e-8) * (F.max("y") - F.min("y") + 1e-8)).alias("area"))
    tenth = kth_distance(nn, DEFAULT_RANK).agg(F.avg("d").alias("mean_nn"), (F.stddev_samp("d") / F.avg("d")).alias("cv_nn"))
    first = kth_distance(nn, 1).agg(F.avg("d").alias("m1"))
    types = cells.groupBy(celltype_col).agg(F.count("*").alias("c")).agg((1 - F.sum(F.col("c").cast("double") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("gini_simpson"))
    n = cells.count()
    moran = categorical_moran(nn, cells.select(F.col("cell_id").alias("id"), F.col(celltype_col).alias("celltype")), moran_neighbours(n))
    out = box.join(tenth).join(first).join(types).join(moran)  # one row each
    return out.select("n", "mean_nn", "cv_nn", (F.col("m1") / (0.5 / F.sqrt(F.col("n") / F.col("area")))).alias("clark_evans"), "gini_simpson", "moran", "area")


def spatial_metrics(cells: DataFrame, nn: DataFrame | None = None, celltype_col: str = "celltype") -> SpatialMetrics:
    n = cells.count()
    nn = knn(points(cells), max(DEFAULT_RANK, moran_neighbours(n))) if nn is None else nn
    row = metrics_frame(cells, nn, celltype_col).first()
    return SpatialMetrics(*row)


def select_method(m: SpatialMetrics) -> tuple[str, dict]:
    """Graph method for the sizes and spread of the cells."""
    if m.n > 50_000:
        return "window", {"k": 6}
    if m.moran is None:
        warnings.warn("no spatial autocorrelation: fewer than two types or cells")
    elif m.moran >= 0.4:
        return "radius", {}
    if m.cv_nn is not None and m.clark_evans is not None and m.cv_nn < 0.3 and 0.85 <= m.clark_evans <= 1.15:
        return ("knn", {}) if 0.95 <= m.clark_evans <= 1.05 else ("radius", {})
    return "delaunay", {"max_edge_length": None if m.mean_nn is None else 2 * m.mean_nn}


def _undirected(pairs: DataFrame) -> DataFrame:
    """``from, to, dist`` of ``id, nid, d2``: one row for each unordered pair, its smallest distance."""
    return pairs.groupBy(F.least("id", "nid").alias("from"), F.greatest("id", "nid").alias("to")).agg(F.sqrt(F.min("d2")).alias("dist"))


def edges_knn(cells: DataFrame, k: int, nn: DataFrame | None = None) -> DataFrame:
    return _undirected((knn(points(cells), k) if nn is None else nn).where(F.col("rn") <= k))


def degree_cap(n: int, area: float, radius: float, k_cap: int = 50) -> int:
    return max(5, min(k_cap, round(n / area * math.pi * radius * radius)))


def edges_radius(cells: DataFrame, radius: float, k_cap: int | None = 50) -> DataFrame:
    """Pairs within the radius (inclusive), of each cell at most the expected degree of nearest ones; all of them if ``k_cap`` is None."""
    p = points(cells)
    if k_cap is not None:
        n, x0, x1, y0, y1 = extent(p)
        if x0 is None or y0 is None:
            return _undirected(range_join(p, p, radius))  # none
        cap = degree_cap(n, (x1 - x0 + 1e-8) * (y1 - y0 + 1e-8), radius, k_cap)
        return _undirected(knn(p, cap).where(F.col("d2") <= radius * radius))
    if p.groupBy("id").count().where("count > 1").limit(1).count():
        return _undirected(range_join(p, p, radius))
    return range_pairs(p, radius).select(F.col("id").alias("from"), F.col("nid").alias("to"), F.sqrt("d2").alias("dist"))


#: Tiles along a side of a task's square; neighbours looked at beyond k for cells near a block's border.
SQUARE = 4
SPARE = 4


def _window_edges(k: int, tile: float):
    """Edges that the cells of one square of tiles get from all their blocks, each pair once."""

    def run(key, cells):
        cells = cells.sort_by("id")
        ids, x, y, gx, gy = (cells.column(c).to_numpy() for c in ("id", "x", "y", "gx", "gy"))
        kind = cells.schema.field("id").type
        code = np.arange(len(ids))
        mine = np.flatnonzero((gx // SQUARE == key[0].as_py()) & (gy // SQUARE == key[1].as_py()))
        tiles, of = np.unique(np.column_stack((gx, gy)), axis=0, return_inverse=True)
        of, taken = of.ravel(), set(map(tuple, tiles.tolist()))
        found = []
        some, c, d2 = nearest(x[mine], y[mine], code[mine], x, y, code, k)
        some = mine[some]
        count = np.bincount(some, minlength=len(ids))
        last = np.zeros(len(ids))
        np.maximum.at(last, some, d2)
        reach = np.where(count >= k, np.sqrt(last) * (1 + 1e-9), np.inf)
        # every block of a cell has its whole tile: none matters if the circle stays inside
        room = np.minimum(np.minimum(x - gx * tile, (gx + 1) * tile - x), np.minimum(y - gy * tile, (gy + 1) * tile - y)) - 1e-9 * (np.abs(x) + np.abs(y) + tile)
        inner = reach < room
        keep_ = inner[some]
        found.append((some[keep_], c[keep_], d2[keep_]))
        left = mine[~inner[mine]]
        if len(left):
            q, c, d2 = nearest(x[left], y[left], code[left], x, y, code, SPARE * k)
            q = left[q]
            by = np.lexsort((c, d2, q))
            q, c, d2 = q[by], c[by], d2[by]
            whole = np.bincount(q, minlength=len(ids)) < SPARE * k  # nothing lies beyond
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    has = np.array([(a + i, b + j) in taken for a, b in tiles.tolist()], dtype=bool)[of]
                    ok = has[q] & (np.abs(gx[c] - gx[q] - i) <= 1) & (np.abs(gy[c] - gy[q] - j) <= 1)
                    a, b, d = q[ok], c[ok], d2[ok]
                    place = np.arange(len(a)) - np.searchsorted(a, a)
                    got = np.bincount(a, minlength=len(ids))
                    full = (got >= k) | whole
                    take = (place < k) & full[a]
                    found.append((a[take], b[take], d[take]))
                    # the rest meet the whole block
                    more = left[has[left] & ~full[left]]
                    by = np.lexsort((gy[more], gx[more]))
                    more = more[by]
                    for at in np.split(more, np.flatnonzero((np.diff(gx[more]) != 0) | (np.diff(gy[more]) != 0)) + 1):
                        if len(at):
                            block = np.flatnonzero((np.abs(gx - gx[at[0]] - i) <= 1) & (np.abs(gy - gy[at[0]] - j) <= 1))
                            a, b, d = nearest(x[at], y[at], code[at], x[block], y[block], code[block], k)
                            found.append((at[a], block[b], d))
        a, b, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        low, high = np.minimum(a, b), np.maximum(a, b)
        _, first = np.unique(low * len(ids) + high, return_index=True)
        to = cells.column("id").combine_chunks()
        return pa.table([to.take(pa.array(low[first])).cast(kind), to.take(pa.array(high[first])).cast(kind), pa.array(d[first])], names=["from", "to", "d2"])

    return run


def edges_window(cells: DataFrame, k: int, tile: float) -> DataFrame:
    """kNN graph within the 3 x 3 block around every tile that has cells, for every cell of the block; the union of all blocks.

    Squares of tiles and the two tiles around them meet in a task, so it has all blocks of its cells. A cell is looked up once, and by blocks
    only where its circle leaves its tile. A task gives at most 9 k rows a cell, not its pairs. Coordinates that are null take no part.
    """
    p = points(cells).where("x IS NOT NULL AND y IS NOT NULL").withColumn("gx", F.floor(F.col("x") / tile)).withColumn("gy", F.floor(F.col("y") / tile))
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2) / SQUARE), F.floor((F.col(c) + 2) / SQUARE)))
    member = p.withColumn("sx", spread("gx")).withColumn("sy", spread("gy"))
    kind = p.schema["id"].dataType
    schema = T.StructType([T.StructField("from", kind), T.StructField("to", kind), T.StructField("d2", T.DoubleType())])
    found = member.groupBy("sx", "sy").applyInArrow(_window_edges(k, tile), schema)
    return found.groupBy("from", "to").agg(F.sqrt(F.min("d2")).alias("dist"))


def with_types(edges: DataFrame, cells: DataFrame, id_col: str = "cell_id", celltype_col: str = "celltype") -> DataFrame:
    at = cells.select(F.col(id_col).alias("_id"), F.col(celltype_col).alias("_t"))
    a = at.select(F.col("_id").alias("from"), F.col("_t").alias("from_type"))
    b = at.select(F.col("_id").alias("to"), F.col("_t").alias("to_type"))
    return edges.join(a, "from", "left").join(b, "to", "left").select("from", "to", "dist", "from_type", "to_type", (F.col("from_type") == F.col("to_type")).alias("same_type"))


def cap_edges(edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A weighted sample without replacement, weight 1 / dist, the same on every run: the ``most`` smallest exponential keys."""
    head = F.left(F.md5(F.concat_ws(",", "from", "to", F.lit(seed))), F.lit(13))  # 52 bits that other engines give too
    u = (F.conv(head, 16, 10).cast("long") + 1) / float(1 << 52)
    return edges.withColumn("_key", -F.log(u) * (F.col("dist") + EPS)).orderBy("_key", "from", "to").limit(most).drop("_key")


def round_even(v: float) -> int:
    return max(2, int(2 * round(v / 2)))


@dataclass
class WindowSize:
    window_size: int
    sliding_step: int
    mean_cells: float | None
    x_range: float
    y_range: float
    converged: bool


def optimal_window_size(cells: DataFrame, min_cells: int = 30, max_cells: int = 50, range_divisor: int = 100, max_iter: int = 100) -> WindowSize:
    """Five aggregated numbers, then a search on them; it can stall on small extents and then says so."""
    n, x0, x1, y0, y1 = extent(points(cells))
    if not n:
        raise ValueError("no cells with coordinates")
    xr, yr = x1 - x0, y1 - y0
    if min(xr, yr) <= 0:
        return WindowSize(2, 1, None, xr, yr, False)
    w, mean, fine = round_even(min(xr, yr) / range_divisor), None, False
    for _ in range(max_iter):
        tiles = (math.floor(x1 / w) - math.floor(x0 / w) + 1) * (math.floor(y1 / w) - math.floor(y0 / w) + 1)
        mean = n / tiles
        if min_cells <= mean <= max_cells:
            fine = True
            break
        w = round_even(w * (1.1 if mean < min_cells else 0.9))
    if not fine:
        warnings.warn("no window size within the bounds was found")
    return WindowSize(w, max(1, w // 2), mean, xr, yr, fine)


def optimal_radius(cells: DataFrame, sample_size: int = 1000, multiplier: float = 2.0, k: int = 10, seed: int = 123) -> DataFrame:
    """One row: recommended radius, its parts, and the mean of the pairwise distances of a seeded sample."""
    p = points(cells).where("x IS NOT NULL AND y IS NOT NULL")
    if p.count() < 2 or k < 1:
        raise ValueError("at least two cells and one neighbour are needed")
    d = kth_distance(knn(p, k), k)
    d = keep(d, "kth-distances")
    q90 = F.lit(exact_quantiles(d, "d", [0.9])[0])
    main = d.agg((q90 * multiplier).alias("recommended"), q90.alias("q90"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"))
    some = p.orderBy(F.md5(F.concat_ws(",", "id", F.lit(seed))), "id").limit(sample_size)
    a, b = some.alias("a"), some.alias("b")
    dist = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    pairs = a.join(b, F.col("a.id") < F.col("b.id")).select(dist.alias("d")).where("d > 0").agg(F.avg("d").alias("mean_pairwise"), F.count("*").alias("pairs"))
    return main.join(pairs)


def build_spatial_network(cells: DataFrame, method: str = "auto", k: int | None = None, radius: float | None = None, window_size: float | None = None, max_edges: int = 1_000_000, celltype_col: str = "celltype", max_edge_length: float | None = None, seed: int = 42) -> NetworkResult:
    """Edges ``from, to, dist, from_type, to_type, same_type`` by the chosen method; parameters given win over those of the automatic choice, then defaults."""
    from .geometry import edges_delaunay

    if method not in ("auto", "knn", "radius", "delaunay", "window"):
        raise ValueError(f"unknown method {method}")
    n = cells.count()
    if n < 2:
        none = with_types(cells.select(F.col("cell_id").alias("from"), F.col("cell_id").alias("to"), F.lit(0.0).alias("dist")).where(F.lit(False)), cells, celltype_col=celltype_col)
        return NetworkResult(none, None, method)
    # one neighbour relation serves the metrics and the graph
    most = max(DEFAULT_RANK, moran_neighbours(n), k or default_k(n))
    nn = keep(knn(points(cells), most), "nn")
    m = spatial_metrics(cells, nn, celltype_col)
    params: dict = {}
    if method == "auto":
        method, params = select_method(m)
    k = k or params.get("k") or default_k(n)
    if method == "knn":
        edges, params = edges_knn(cells, k, nn), {"k": k}
    elif method == "radius":
        radius = radius or 2 * m.mean_nn
        edges, params = edges_radius(cells, radius, max(20, 3 * k)), {"radius": radius, "k_cap": max(20, 3 * k)}
    elif method == "window":
        size = window_size or optimal_window_size(cells).window_size
        edges, params = edges_window(cells, min(k, 10), size), {"k": min(k, 10), "window_size": size, "sliding_step": max(1, int(size) // 2)}
    else:
        longest = max_edge_length or params.get("max_edge_length")
        edges, params = edges_delaunay(cells, longest), {"max_edge_length": longest}
    edges = keep(with_types(edges, cells, celltype_col=celltype_col), "edges")
    found = edges.count()
    if not found:
        warnings.warn("the network has no edges")
    if found > max_edges:
        edges = cap_edges(edges, max_edges, seed)
    return NetworkResult(edges, m, method, params)
