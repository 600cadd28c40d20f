"""Cell tables: preparation, quality filter, labels, coordinates, composition."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import exact_quantiles
from ..functions.stats import is_finite
from ..plans.storage import keep, numbered


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def axis(df: DataFrame, name: str | None, default: str) -> str:
    """The column of an axis: the one named, else the capital, else the small letter."""
    if name is not None and name in df.columns:
        return name
    for c in (default, default.lower()):
        if c in df.columns:
            return c
    raise ValueError(f"no column for {default}")


def prepare_data(df: DataFrame, cell_id_col: str | None = None, x_col: str = "X", y_col: str = "Y", celltype_col: str = "celltype") -> DataFrame:
    """One id column ``Cell_ID``, finite numeric ``X`` and ``Y``, no null type. The id is the named column, ``V1``, ``Cell_ID``, ``cell`` or a row number in order of the coordinates."""
    found = cell_id_col if cell_id_col in df.columns else next((c for c in ("V1", "Cell_ID", "cell") if c in df.columns), None)
    if found and found != "Cell_ID":
        old = [c for c in df.columns if c.lower() == "cell_id" and c != found]  # names of columns have no case in Spark
        df = df.drop(*old).withColumnRenamed(found, "Cell_ID")
    for name, given in (("X", x_col), ("Y", y_col)):
        source = axis(df, given, name)
        if source.lower() != name.lower():
            df = df.drop(name)
        df = df.withColumnRenamed(source, name)
        df = df.withColumn(name, F.col(name).cast("string").try_cast("double"))
    df = df.where(is_finite(F.col("X")) & is_finite(F.col("Y")))
    if celltype_col in df.columns:
        df = df.where(F.col(celltype_col).isNotNull())
    if not found:
        df = numbered(df, ["X", "Y"], "Cell_ID")
    return df


def filter_data(cells: DataFrame, mad_threshold: float = 3, quantile: float = 0.05, count_col: str = "n_count", feature_col: str = "n_feature") -> DataFrame:
    """Cells whose count lies strictly within ``mad_threshold`` deviations of the median and whose features are strictly above a quantile."""
    cells = keep(cells, "cells-to-filter")  # read once for each pass over a quantile
    middle, low = exact_quantiles(cells, count_col, [0.5])[0], exact_quantiles(cells, feature_col, [quantile])[0]
    if middle is None or low is None:
        return cells.where(F.lit(False))
    off = F.abs(F.col(count_col) - F.lit(middle))
    spread = exact_quantiles(cells, off, [0.5])[0]
    return cells.where((off < mad_threshold * spread) & (F.col(feature_col) > F.lit(low)))


def annotate_celltypes(cells: DataFrame, cluster_ids: list, labels: list[str], cluster_col: str = "cluster", out: str = "celltype") -> DataFrame:
    """Adds the label of each cell's cluster, null where there is none; of ids given twice the first label counts."""
    if len(cluster_ids) != len(labels):
        raise ValueError("as many labels as cluster ids are needed")
    table: dict[str, str] = {}
    for i, label in zip(cluster_ids, labels):
        table.setdefault(str(i), label)
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    return cells.withColumn(out, F.try_element_at(mapping, F.col(cluster_col).cast("string")))


def unknown_clusters(cells: DataFrame, cluster_ids: list, cluster_col: str = "cluster") -> list[str]:
    """Given ids that no cell has; the ids are few, so they are looked for in one pass."""
    ids = sorted({str(i) for i in cluster_ids})
    there = {r[0] for r in cells.where(F.col(cluster_col).cast("string").isin(ids)).select(F.col(cluster_col).cast("string")).distinct().collect()}
    missing = [i for i in ids if i not in there]
    if missing:
        warnings.warn(f"clusters without cells: {', '.join(missing)}")
    return missing


def extract_coordinates(cells: DataFrame, embedding: DataFrame | None = None, id_col: str = "cell_id") -> DataFrame:
    """``X`` and ``Y`` of the cells, or else of the first two components of their spatial embedding."""
    if embedding is None:
        require(cells, "X", "Y")
        return cells
    at = embedding.select(id_col, F.get("vec", F.lit(0)).alias("_x"), F.get("vec", F.lit(1)).alias("_y"))
    have = {"X", "Y"} <= set(cells.columns)
    joined = cells.join(at, id_col, "left")
    for c, e in (("X", "_x"), ("Y", "_y")):
        joined = joined.withColumn(c, F.coalesce(c, e) if have else F.col(e))
    return joined.drop("_x", "_y")


def cluster_composition(df: DataFrame, cluster_col: str = "cluster", celltype_col: str = "celltype") -> DataFrame:
    require(df, cluster_col, celltype_col)
    counts = df.groupBy(F.col(cluster_col).alias("cluster"), F.col(celltype_col).alias("celltype")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("cluster"))
    return counts.select("cluster", "celltype", "count", total.alias("total"), (F.col("count") / total).alias("proportion"))


def composition_matrix(composition: DataFrame, types: list[str], value_col: str = "proportion") -> DataFrame:
    """A row for each cluster and a column for each of ``types``, 0 where there is nothing, clipped to [0, 1]."""
    wide = composition.where("cluster IS NOT NULL AND celltype IS NOT NULL").groupBy("cluster").pivot("celltype", types).agg(F.sum(value_col))
    return wide.select("cluster", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(f"`{t}`"), F.lit(0.0)))).alias(t) for t in types])


def composition_z(composition: DataFrame, types: list[str], value_col: str = "proportion") -> DataFrame:
    """Row z-scores of the matrix, long; null for a constant row."""
    long = composition_matrix(composition, types, value_col).unpivot("cluster", types, "celltype", "value")
    row = Window.partitionBy("cluster")
    return long.select("cluster", "celltype", "value", F.try_divide(F.col("value") - F.avg("value").over(row), F.stddev_samp("value").over(row)).alias("z"))


def composition_bars(composition: DataFrame) -> DataFrame:
    """Shares of each bar, and the place of each type by its total count."""
    totals = composition.groupBy("celltype").agg(F.sum("count").alias("type_total"))
    order = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("type_total"), "celltype")))
    share = F.col("proportion") / F.sum("proportion").over(Window.partitionBy("cluster"))
    return composition.join(order, "celltype").select("cluster", "celltype", share.alias("share"), "type_total", "place")
