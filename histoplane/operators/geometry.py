"""Delaunay triangulation and Voronoi cells.

Tiles that follow the data are triangulated with a margin around them. A triangle whose circle lies inside its tile and margin is
one of the whole; so are most. What they leave open (the hull's surroundings, gaps wider than a margin, places of four points on a
circle) is triangulated by one task from the corners of those holes alone. The automatic choice of a graph takes Delaunay for at
most 50 000 cells only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import keep
from .neighbours import _sample, _Tree, points

#: Points of a tile that it aims at; as many at most are triangulated in one task at once. A margin's width in mean distances of points.
TILE_POINTS = 1_024
MARGIN = 6.0


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices) of distinct points, by insertion with all circumcircles tested at once."""
    n = len(xy)
    if n < 3:
        return np.empty((0, 3), dtype=np.int64)
    low, span = xy.min(0), max(float(np.ptp(xy, axis=0).max()), 1e-300)
    p = np.vstack(((xy - low) / span, [[-3000.0, -3000.0], [3000.5, -3000.0], [0.5, 6000.0]]))
    tri = np.zeros((2 * n + 16, 3), dtype=np.int64)
    centre, r2 = np.zeros((2 * n + 16, 2)), np.full(2 * n + 16, -1.0)

    def put(at, t):
        tri[at] = t
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        ab, ac = b - a, c - a
        d = 2 * (ab[:, 0] * ac[:, 1] - ab[:, 1] * ac[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            b2, c2 = (ab**2).sum(1), (ac**2).sum(1)
            u = np.column_stack(((ac[:, 1] * b2 - ab[:, 1] * c2) / d, (ab[:, 0] * c2 - ac[:, 0] * b2) / d))
        centre[at], r2[at] = a + u, (u**2).sum(1)

    put(np.array([0]), np.array([[n, n + 1, n + 2]]))
    used = 1
    for i in np.lexsort((p[:n, 1], np.floor(p[:n, 0] * max(1, int(np.sqrt(n) / 2))))):
        d = centre[:used] - p[i]
        gap = d[:, 0] ** 2 + d[:, 1] ** 2 - r2[:used]
        within = gap < 0
        # close to a circle, wide ones above all, the corners as seen from the point decide
        close = np.flatnonzero(np.abs(gap) <= 1e-6 * r2[:used])
        if len(close):
            (ax, ay), (bx, by), (cx, cy) = ((p[tri[close, v]] - p[i]).T for v in range(3))
            a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            det = ax * (by * c2 - cy * b2) - ay * (bx * c2 - cx * b2) + a2 * (bx * cy - cx * by)
            turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
            within[close] = det * np.sign(turn) >= -1e-13 * np.minimum(np.minimum(a2, b2), c2) * np.abs(turn)
        bad = np.flatnonzero(within & (r2[:used] >= 0))
        t = tri[bad]
        edges = np.vstack((t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]))
        key = np.minimum(edges[:, 0], edges[:, 1]) * (n + 3) + np.maximum(edges[:, 0], edges[:, 1])
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        rim = edges[first[count == 1]]
        new = np.column_stack((rim, np.full(len(rim), i)))
        at = np.concatenate((bad, np.arange(used, used + max(0, len(new) - len(bad)))))[: len(new)]
        r2[bad] = -1.0
        used = max(used, int(at.max()) + 1)
        put(at, new)
    out = tri[:used][(r2[:used] >= 0) & (tri[:used] < n).all(1)]
    a, b, c = xy[out[:, 0]], xy[out[:, 1]], xy[out[:, 2]]
    return out[np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) > 0]


def hull(xy: np.ndarray) -> list[int]:
    order = np.lexsort((xy[:, 1], xy[:, 0])).tolist()

    def half(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and (xy[out[-1], 0] - xy[out[-2], 0]) * (xy[i, 1] - xy[out[-2], 1]) - (xy[out[-1], 1] - xy[out[-2], 1]) * (xy[i, 0] - xy[out[-2], 0]) < 0:
                out.pop()
            out.append(i)
        return out

    return half(order)[:-1] + half(order[::-1])[:-1]


def delaunay_pairs(xy: np.ndarray) -> np.ndarray:
    """Distinct index pairs (i < j) of the triangulation and its hull; collinear points make a path, coincident ones join their first."""
    unique, first, inverse = np.unique(xy, axis=0, return_index=True, return_inverse=True)
    t = delaunay(unique)
    pairs = [t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]
    if not len(t) and len(unique) > 1:
        order = np.lexsort((unique[:, 1], unique[:, 0]))
        pairs.append(np.column_stack((order[:-1], order[1:])))
    elif len(unique) > 2:
        h = hull(unique)
        pairs.append(np.column_stack((h, h[1:] + h[:1])))
    e = first[np.vstack(pairs)] if len(unique) > 1 else np.empty((0, 2), dtype=np.int64)
    same = np.flatnonzero(first[inverse.ravel()] != np.arange(len(xy)))
    e = np.vstack((e, np.column_stack((first[inverse.ravel()][same], same))))
    return np.unique(np.sort(e, axis=1), axis=0)


def _widths(tree: _Tree, sample: np.ndarray, each: float) -> np.ndarray:
    """Each leaf's margin; an inner node's is the widest below it."""
    out, leaf = np.zeros(len(tree.dim)), tree.leaf(sample[:, 0], sample[:, 1])
    order = np.argsort(leaf, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        (w, h), n = np.ptp(sample[at], axis=0), max(1.0, len(at) * each)
        out[leaf[at[0]]] = MARGIN * max(np.sqrt(w * h / n), max(w, h) / n)
    for node in range(len(out) - 1, -1, -1):
        if tree.dim[node] >= 0:
            out[node] = max(out[tree.left[node]], out[tree.right[node]])
    return out


def _to_tiles(shared):
    """Points (id, x, y) with every tile whose rectangle and margin hold them."""

    def run(batches):
        tree, width = shared.value
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if not len(at):
                    continue
                if tree.dim[node] >= 0:
                    v, left, right = (x if tree.dim[node] == 0 else y)[at], tree.left[node], tree.right[node]
                    todo += [(left, at[v <= tree.cut[node] + width[left]]), (right, at[v >= tree.cut[node] - width[right]])]
                    continue
                (x0, x1, y0, y1), m = tree.rect[node], width[node]
                at = at[(x[at] >= x0 - m) & (x[at] <= x1 + m) & (y[at] >= y0 - m) & (y[at] <= y1 + m)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), node, dtype=np.int64)), *[batch.column(c).take(pa.array(at)) for c in range(3)]], names=["leaf", "id", "x", "y"])

    return run


def _sure(xy: np.ndarray, t: np.ndarray, region: tuple) -> np.ndarray:
    """Triangles whose circle lies in the region and has no fourth point on it."""
    a = xy[t[:, 0]]
    ab, ac = xy[t[:, 1]] - a, xy[t[:, 2]] - a
    d = 2 * (ab[:, 0] * ac[:, 1] - ab[:, 1] * ac[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        b2, c2 = (ab**2).sum(1), (ac**2).sum(1)
        u = np.column_stack(((ac[:, 1] * b2 - ab[:, 1] * c2) / d, (ab[:, 0] * c2 - ac[:, 0] * b2) / d))
    at, r2 = a + u, (u**2).sum(1)
    r = np.sqrt(r2) * (1 + 1e-9)
    x0, x1, y0, y1 = region
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(r2) & (at[:, 0] - r >= x0) & (at[:, 0] + r <= x1) & (at[:, 1] - r >= y0) & (at[:, 1] + r <= y1)
    ends = np.sort(np.vstack((t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]])), axis=1)
    across, of = np.concatenate((t[:, 2], t[:, 0], t[:, 1])), np.tile(np.arange(len(t)), 3)
    key = ends[:, 0] * len(xy) + ends[:, 1]
    order = np.argsort(key, kind="stable")
    pair = np.flatnonzero(key[order][1:] == key[order][:-1])
    for i, j in ((order[pair], order[pair + 1]), (order[pair + 1], order[pair])):
        with np.errstate(invalid="ignore"):
            tie = ~(((xy[across[j]] - at[of[i]]) ** 2).sum(1) > r2[of[i]] * (1 + 1e-9))
        ok[of[i[tie]]] = ok[of[j[tie]]] = False
    return ok


def _tile_triangles(shared):
    """Sides (from, to, across and their places) of the sure triangles with a corner in the tile."""

    def run(key, cells):
        tree, width = shared.value
        node = key[0].as_py()
        cells = cells.sort_by("id")
        xy = np.column_stack([cells.column(c).to_numpy() for c in ("x", "y")])
        (x0, x1, y0, y1), m = tree.rect[node], width[node]
        t = np.sort(delaunay(xy), axis=1)
        t = t[_sure(xy, t, (x0 - m, x1 + m, y0 - m, y1 + m))] if len(t) else t
        t = t[(tree.leaf(xy[:, 0], xy[:, 1]) == node)[t].any(1)] if len(t) else t
        sides = np.vstack((t, t[:, [0, 2, 1]], t[:, [1, 2, 0]]))
        ids = cells.column("id").combine_chunks()
        columns = {n: ids.take(pa.array(sides[:, i])) for i, n in enumerate(("from", "to", "across"))}
        for i, n in enumerate(("1", "2", "3")):
            columns |= {f"x{n}": pa.array(xy[sides[:, i], 0]), f"y{n}": pa.array(xy[sides[:, i], 1])}
        return pa.table(columns)

    return run


def fill(xy: np.ndarray, rim: np.ndarray, across: np.ndarray) -> np.ndarray | None:
    """Pairs (i < j) of the triangulation inside the holes, but those of their rim; ``across`` are places inside, none a hole's. None if they don't fit.

    All corners of the triangles that are missing are among ``xy``; so they are triangles of ``xy``, and those on the other side of the rim are not.
    """
    n, t = len(xy), delaunay(xy)
    key = lambda e: np.minimum(e[:, 0], e[:, 1]) * n + np.maximum(e[:, 0], e[:, 1])
    side = key(np.vstack((t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]])))
    of, far = np.tile(np.arange(len(t)), 3), np.concatenate((t[:, 2], t[:, 0], t[:, 1]))
    rims = key(rim)
    h = hull(xy)
    outer = key(np.column_stack((h, h[1:] + h[:1])))
    if not np.isin(rims, np.concatenate((side, outer))).all():
        return None
    turn = lambda a, b, c: (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    order = np.argsort(rims)
    hit = np.isin(side, rims)
    e = order[np.searchsorted(rims, side[hit], sorter=order)]
    a, b = xy[rim[e, 0]], xy[rim[e, 1]]
    covered = (turn(a, b, across[e]) > 0) == (turn(a, b, xy[far[hit]]) > 0)
    known = np.zeros(len(t), dtype=np.int64)  # 1 covered, 2 a hole's
    known[of[hit][covered]] = 1
    if (known[of[hit][~covered]] == 1).any():
        return None
    known[of[hit][~covered]] = 2
    order = np.argsort(side, kind="stable")
    pair = np.flatnonzero((side[order][1:] == side[order][:-1]) & ~hit[order][1:])
    i, j = of[order[pair]], of[order[pair + 1]]
    while True:  # what a rim doesn't part is alike
        before = known.copy()
        np.maximum.at(known, i, before[j])
        np.maximum.at(known, j, before[i])
        if (known == before).all():
            break
    if (known[of[hit][covered]] == 2).any():
        return None
    out = np.unique(np.concatenate((side[(known != 1)[of]], outer)))
    out = out[~np.isin(out, rims)]
    return np.column_stack((out // n, out % n))


def _one_task(p: DataFrame, kind: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        xy, ids = pdf[["x", "y"]].to_numpy(), pdf["id"].to_numpy()
        e = delaunay_pairs(xy)
        return pd.DataFrame({"from": ids[e[:, 0]], "to": ids[e[:, 1]], "x1": xy[e[:, 0], 0], "y1": xy[e[:, 0], 1], "x2": xy[e[:, 1], 0], "y2": xy[e[:, 1], 1]})

    return p.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"`from` {kind}, `to` {kind}, x1 double, y1 double, x2 double, y2 double")


def _places(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with coordinates, and one for each place: its smallest id."""
    p = points(cells).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("x", "y")))
    return p, keep(p.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"), "places")


def _mesh(p: DataFrame) -> DataFrame:
    """``from, to, x1, y1, x2, y2``: the triangulation's edges between distinct places, each once."""
    kind = dict(p.dtypes)["id"]
    n = p.count()
    sample = np.array([(r.x, r.y) for r in _sample(p, n, "x", "y")]).reshape(-1, 2)
    if n <= TILE_POINTS or len(sample) < 8:
        return _one_task(p, kind)
    tree = _Tree(sample, n, sample, 1, TILE_POINTS)
    shared = p.sparkSession.sparkContext.broadcast((tree, _widths(tree, sample, n / len(sample))))
    ids = p.schema["id"]
    places = [T.StructField(f"{c}{i}", T.DoubleType()) for i in (1, 2, 3) for c in ("x", "y")]
    tiles = p.mapInArrow(_to_tiles(shared), T.StructType([T.StructField("leaf", T.LongType()), ids, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    sides = tiles.groupBy("leaf").applyInArrow(_tile_triangles(shared), T.StructType([T.StructField(c, ids.dataType) for c in ("from", "to", "across")] + places))
    ends = ["x1", "y1", "x2", "y2"]
    last = F.max(F.struct("across", "x3", "y3"))
    sure = keep(sides.groupBy("from", "to").agg(*[F.first(c).alias(c) for c in ends], F.count_distinct("across").alias("n"), last.alias("o")), "sure-edges")
    rim = sure.where("n = 1")
    # corners of the rim, and points without a sure triangle
    corners = rim.select(F.col("from").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(rim.select(F.col("to").alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y"))).distinct()
    met = sure.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    corners = corners.unionByName(p.join(met, "id", "left_anti"))
    none = F.lit(None).cast(kind)
    rows = corners.select("id", none.alias("to"), "x", "y").unionByName(rim.select(F.col("from").alias("id"), "to", F.col("o.x3").alias("x"), F.col("o.y3").alias("y")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, rims = pdf[pdf["to"].isna()].sort_values("id"), pdf[pdf["to"].notna()]
        ids, xy = at["id"].to_numpy(), at[["x", "y"]].to_numpy()
        rim = np.column_stack([np.searchsorted(ids, rims[c].astype(at["id"].dtype).to_numpy()) for c in ("id", "to")])
        e = delaunay_pairs(xy) if not len(rim) else fill(xy, rim, rims[["x", "y"]].to_numpy())
        if e is None:
            return pd.DataFrame({"from": ids[:1], "to": ids[:1], **dict.fromkeys(ends, 0.0)})
        return pd.DataFrame({"from": ids[e[:, 0]], "to": ids[e[:, 1]], "x1": xy[e[:, 0], 0], "y1": xy[e[:, 0], 1], "x2": xy[e[:, 1], 0], "y2": xy[e[:, 1], 1]})

    filled = keep(rows.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"`from` {kind}, `to` {kind}, x1 double, y1 double, x2 double, y2 double"), "filled")
    if sure.where("n > 2").limit(1).count() or filled.where("`from` = `to`").limit(1).count():
        return _one_task(p, kind)  # rounding: tiles disagree
    return sure.select("from", "to", *ends).unionByName(filled)


def edges_delaunay(cells: DataFrame, max_edge_length: float | None = None) -> DataFrame:
    p, places = _places(cells)
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    out = _mesh(places).select("from", "to", F.sqrt(dx * dx + dy * dy).alias("dist"))
    # coincident cells join the first
    same = p.join(places.select(F.col("id").alias("from"), "x", "y"), ["x", "y"]).where("id <> `from`").select("from", F.col("id").alias("to"), F.lit(0.0).alias("dist"))
    out = out.unionByName(same)
    return out if max_edge_length is None else out.where(F.col("dist") <= max_edge_length)


def voronoi(cells: DataFrame) -> DataFrame:
    """``cell_id, vertex_no, x, y``: each cell's polygon, its box cut by the bisectors to its Delaunay neighbours."""
    _, p = _places(cells)
    ids = p.schema["id"].dataType
    x0, x1, y0, y1 = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    e = _mesh(p)
    near = e.select(F.col("from").alias("id"), F.struct(F.col("to").alias("nid"), F.col("x2").alias("x"), F.col("y2").alias("y")).alias("o"))
    near = near.unionByName(e.select(F.col("to").alias("id"), F.struct(F.col("from").alias("nid"), F.col("x1").alias("x"), F.col("y1").alias("y")).alias("o")))
    around = near.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    rows = p.join(around, "id", "left").select("id", "x", "y", F.transform("o", lambda o: o["x"]).alias("nx"), F.transform("o", lambda o: o["y"]).alias("ny"))

    def run(batches):
        for batch in batches:
            at, number, xs, ys = [], [], [], []
            for i, (x, y, nx_, ny_) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3, 4)])):
                poly = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
                for ox, oy in zip(nx_ or (), ny_ or ()):
                    nx, ny = ox - x, oy - y
                    c = (nx * (x + ox) + ny * (y + oy)) / 2
                    side = [nx * u + ny * v - c for u, v in poly]
                    cut = []
                    for (a, s), (b, t) in zip(zip(poly, side), zip(poly[1:] + poly[:1], side[1:] + side[:1])):
                        if s <= 0:
                            cut.append(a)
                        if (s < 0 < t) or (t < 0 < s):
                            f = s / (s - t)
                            cut.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
                    poly = cut
                at += [i] * len(poly)
                number += range(len(poly))
                xs += [v[0] for v in poly]
                ys += [v[1] for v in poly]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["cell_id", "vertex_no", "x", "y"])

    return rows.mapInArrow(run, T.StructType([T.StructField("cell_id", ids), T.StructField("vertex_no", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def voronoi_areas(polygons: DataFrame) -> DataFrame:
    ring = F.array_sort(F.collect_list(F.struct("vertex_no", "x", "y")))
    g = polygons.groupBy("cell_id").agg(ring.alias("r"))
    at = lambda i: F.element_at("r", i)
    n = F.size("r")
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(i % n + 1)["y"] - at(i)["y"] * at(i % n + 1)["x"])
    return g.select("cell_id", (F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2).alias("area"))


def voronoi_plot(polygons: DataFrame, cells: DataFrame, category_col: str = "celltype", highlight: tuple[str, list] | None = None) -> DataFrame:
    """Polygon vertices with their cell's category; with ``highlight`` (column, values) cells of other values are ``Background``."""
    shown = F.lit(True) if highlight is None else F.coalesce(F.col(highlight[0]).isin(highlight[1]), F.lit(False))
    category = F.when(shown, F.col(category_col).cast("string")).otherwise("Background")
    return polygons.join(cells.select("cell_id", category.alias("category"), shown.alias("highlighted")), "cell_id")


def plot_limits(polygons: DataFrame, margin: float = 0.05) -> DataFrame:
    """One row: the extent of both axes, widened on either side by a share of its length."""
    ends = polygons.agg(*[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))])
    wide = lambda c: margin * (F.col(f"{c}1") - F.col(f"{c}0"))
    return ends.select(*[(F.col(f"{c}{i}") + (2 * i - 1) * wide(c)).alias(f"{c}_{n}") for c in ("x", "y") for i, n in enumerate(("low", "high"))])
