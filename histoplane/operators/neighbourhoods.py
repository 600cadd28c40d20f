"""What neighbourhoods hold: type distances, features, purity, interactions, and the tables behind their plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import exact_quantiles
from ..plans.storage import keep
from .neighbours import knn, kth_distance, points, type_counts


def celltype_distances(cells: DataFrame, celltype_col: str = "celltype") -> DataFrame:
    """``source, target, mean_dist, n``: mean over the source type's cells of the distance to the nearest other cell of the target type."""
    p = points(cells, "cell_id", "X", "Y", F.col(celltype_col).alias("target"))
    nearest = knn(p, 1, by="target")
    source = cells.select(F.col("cell_id").alias("id"), F.col(celltype_col).alias("source"))
    return nearest.join(source, "id").groupBy("source", "target").agg(F.avg(F.sqrt("d2")).alias("mean_dist"), F.count("*").alias("n"))


def celltype_distance_lists(cells: DataFrame, celltype_col: str = "celltype") -> DataFrame:
    """``source, target, id, dist``: the distances behind the means, a row each rather than a list."""
    p = points(cells, "cell_id", "X", "Y", F.col(celltype_col).alias("target"))
    return knn(p, 1, by="target").join(cells.select(F.col("cell_id").alias("id"), F.col(celltype_col).alias("source")), "id").select("source", "target", "id", F.sqrt("d2").alias("dist"))


def global_nn_stats(cells: DataFrame) -> DataFrame:
    d = keep(kth_distance(knn(points(cells), 1), 1), "nearest-distances")
    q90 = F.lit(exact_quantiles(d, "d", [0.9])[0]).cast("double")
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_dist"), q90.alias("q90"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"))


def _adjacent(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from").alias("id"), F.col("to").alias("nid")).unionByName(edges.select(F.col("to").alias("id"), F.col("from").alias("nid"))).where("id <> nid").distinct()


def neighbourhood_features_long(cells: DataFrame, edges: DataFrame, celltype_col: str = "celltype") -> DataFrame:
    """``id, nbr_type, prop`` for types among a cell's neighbours; neighbours outside the table don't count."""
    near = _adjacent(edges).join(cells.select(F.col("cell_id").alias("nid"), F.col(celltype_col).alias("nbr_type")), "nid")
    counts = near.groupBy("id", "nbr_type").agg(F.count("*").alias("c"))
    return counts.select("id", "nbr_type", (F.col("c") / F.sum("c").over(Window.partitionBy("id"))).alias("prop"))


def neighbourhood_features(cells: DataFrame, edges: DataFrame, types: list[str], celltype_col: str = "celltype") -> DataFrame:
    """The cells with ``Nbr_<type>``, ``Centroid_X/Y`` and ``Rel_X/Y``; zeros, and so minus its place, for a cell without neighbours."""
    at = cells.select(F.col("cell_id").alias("nid"), F.col(celltype_col).alias("_t"), F.col("X").alias("_x"), F.col("Y").alias("_y"))
    share = [F.avg(F.when(F.col("_t") == t, 1.0).otherwise(0.0)).alias(f"Nbr_{t}") for t in types]
    near = _adjacent(edges).join(at, "nid").groupBy("id").agg(*share, F.avg("_x").alias("Centroid_X"), F.avg("_y").alias("Centroid_Y"))
    new = [f"Nbr_{t}" for t in types] + ["Centroid_X", "Centroid_Y"]
    out = cells.join(near.withColumnRenamed("id", "cell_id"), "cell_id", "left").select(*cells.columns, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in new])
    return out.withColumn("Rel_X", F.col("Centroid_X") - F.col("X")).withColumn("Rel_Y", F.col("Centroid_Y") - F.col("Y"))


def purity(cells: DataFrame, method: str = "window", k: int = 30, radius: float = 30.0, min_cells: int = 5, celltype_col: str = "celltype") -> DataFrame:
    """``cell_id, neighbours, purity``: share of the commonest type among a cell's neighbours, null below ``min_cells``.

    window: the square of that side around the cell; radius: 0 < d <= radius; knn: the k nearest; delaunay: the graph's.
    """
    typed = points(cells, "cell_id", "X", "Y", F.col(celltype_col).alias("t"))
    if method in ("window", "radius"):
        found = type_counts(typed, radius / 2 if method == "window" else radius, method == "window")
    elif method in ("knn", "delaunay"):
        if method == "knn":
            pairs = knn(typed.drop("t"), k).select("id", "nid")
        else:
            from .geometry import edges_delaunay

            pairs = _adjacent(edges_delaunay(cells))
        near = pairs.join(typed.select(F.col("id").alias("nid"), "t"), "nid")
        counts = near.groupBy("id", "t").agg(F.count("*").alias("c"))
        found = counts.groupBy("id").agg(F.sum("c").alias("neighbours"), F.max("c").alias("most"))
    else:
        raise ValueError(f"unknown method {method}")
    share = F.when(F.col("neighbours") >= min_cells, F.col("most") / F.col("neighbours"))
    return cells.select("cell_id").join(found.withColumnRenamed("id", "cell_id"), "cell_id", "left").select("cell_id", F.coalesce("neighbours", F.lit(0)).cast("long").alias("neighbours"), share.alias("purity"))


def interactions(cells: DataFrame, edges: DataFrame, celltype_col: str = "celltype", double_diagonal: bool = True) -> DataFrame:
    """``type1, type2, n``: the full symmetric matrix of edges between types, zeros too; edges within a type count twice."""
    at = cells.select(F.col("cell_id").cast("string").alias("_id"), F.col(celltype_col).alias("_t")).where("_t IS NOT NULL")
    a = at.select(F.col("_id").alias("_a"), F.col("_t").alias("a"))
    b = at.select(F.col("_id").alias("_b"), F.col("_t").alias("b"))
    joined = edges.select(F.col("from").cast("string").alias("_a"), F.col("to").cast("string").alias("_b")).join(a, "_a").join(b, "_b")
    counts = joined.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    both = counts.select(F.col("a").alias("type1"), F.col("b").alias("type2"), F.when(F.col("a") == F.col("b"), F.col("n") * (2 if double_diagonal else 1)).otherwise(F.col("n")).alias("n"))
    both = both.unionByName(counts.where("a <> b").select(F.col("b").alias("type1"), F.col("a").alias("type2"), "n"))
    types = joined.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    grid = types.select(F.col("t").alias("type1")).join(F.broadcast(types.select(F.col("t").alias("type2"))))  # types squared
    return grid.join(both, ["type1", "type2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def interaction_heat(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("value", F.log2(F.col("n") + 1))


def interaction_nodes(matrix: DataFrame, max_nodes: int = 50) -> DataFrame:
    """Degree and strength of each type in the weighted graph, the strongest ``max_nodes``."""
    nodes = matrix.groupBy(F.col("type1").alias("type")).agg(F.count_if(F.col("n") > 0).alias("degree"), F.sum("n").alias("strength"))
    return nodes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), "type"))).where(F.col("place") <= max_nodes)


def interaction_subgraph(matrix: DataFrame, max_nodes: int = 50) -> DataFrame:
    keep = interaction_nodes(matrix, max_nodes).select("type")
    return matrix.where("n > 0 AND type1 <= type2").join(keep.withColumnRenamed("type", "type1"), "type1", "left_semi").join(keep.withColumnRenamed("type", "type2"), "type2", "left_semi")


def distance_heat(distances: DataFrame) -> DataFrame:
    """The long matrix with the side of its median each value lies on, and the colour stops at seven quantiles."""
    stops = distances.agg(F.percentile("mean_dist", F.array(*[F.lit(q) for q in (0.0, 0.2, 0.4, 0.5, 0.7, 0.9, 1.0)])).alias("stops"), F.median("mean_dist").alias("middle"))
    return distances.join(F.broadcast(stops)).select("source", "target", "mean_dist", (F.col("mean_dist") < F.col("middle")).alias("below_median"), "stops")


def network_segments(cells: DataFrame, edges: DataFrame, mode: str = "all", top_n: int = 1000, max_edges: int = 1000, seed: int = 42) -> DataFrame:
    """Edges with both ends' places and strength 1 / dist: all, the ``top_n`` strongest, or a seeded sample."""
    at = cells.select(F.col("cell_id").alias("_id"), F.col("X").alias("_x"), F.col("Y").alias("_y"))
    out = edges.join(at.select(F.col("_id").alias("from"), F.col("_x").alias("x1"), F.col("_y").alias("y1")), "from").join(at.select(F.col("_id").alias("to"), F.col("_x").alias("x2"), F.col("_y").alias("y2")), "to")
    if "dist" not in out.columns:
        out = out.withColumn("dist", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")))
    out = out.select("from", "to", "x1", "y1", "x2", "y2", "dist", F.try_divide(F.lit(1.0), F.col("dist")).alias("strength"))
    if mode == "top":
        return out.orderBy(F.desc("strength"), "from", "to").limit(top_n)
    if mode == "random":
        return out.orderBy(F.md5(F.concat_ws(",", "from", "to", F.lit(seed))), "from", "to").limit(max_edges)
    if mode != "all":
        raise ValueError(f"unknown mode {mode}")
    return out


def plot_sample(df: DataFrame, most: int = 10_000, seed: int = 42, id_col: str = "cell_id") -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(",", id_col, F.lit(seed))), id_col).limit(most)
