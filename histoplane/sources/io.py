"""Readers and writers of cell tables and expression matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import numbered


@dataclass
class Dataset:
    """``cells(cell_id, X, Y, n_count, n_feature, ...)`` and ``expr(cell_id, feature, value)``."""

    cells: DataFrame
    expr: DataFrame


def _totals(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("value").alias("n_count"), F.count_if(F.col("value") > 0).alias("n_feature"))


def read_counts_coords(spark: SparkSession, counts: str, coords: str) -> Dataset:
    """A features-by-cells CSV and a CSV of coordinates; cells that both have stay, none in common is an error."""
    wide = spark.read.csv(counts, header=True, inferSchema=True)
    names = wide.columns
    expr = wide.unpivot(names[0], names[1:], "cell_id", "value").select("cell_id", F.col(names[0]).cast("string").alias("feature"), F.col("value").cast("double").alias("value"))
    at = spark.read.csv(coords, header=True)
    cols = at.columns
    if not {"X", "Y"} <= set(cols):
        at = at.withColumnRenamed(cols[1], "X").withColumnRenamed(cols[2], "Y")
    at = at.withColumnRenamed(cols[0], "cell_id").withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("X", "Y")})
    cells = at.join(_totals(expr), "cell_id")
    if cells.isEmpty():
        raise ValueError("the two files have no cell in common")
    return Dataset(cells, expr.join(at.select("cell_id"), "cell_id", "left_semi"))


def read_measurements(spark: SparkSession, path: str, x_col: str | None = None, y_col: str | None = None, id_col: str | None = None) -> Dataset:
    """One CSV with a row per cell: centroid columns are found by name, every other numeric column is a marker."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    low = {c.lower(): c for c in df.columns}
    find = lambda given, axis: given or next(c for l, c in low.items() if l == axis or l.startswith(f"centroid {axis}"))  # noqa: E731, E741
    x, y = find(x_col, "x"), find(y_col, "y")
    if not id_col:
        df = numbered(df, [F.col(f"`{x}`"), F.col(f"`{y}`")], "cell_id")
    cell = F.col(f"`{id_col}`").cast("string") if id_col else F.concat(F.lit("cell_"), F.col("cell_id").cast("string"))
    df = df.withColumn("cell_id", cell)
    markers = [c for c, t in df.dtypes if c not in (x, y, id_col, "cell_id") and t in ("int", "bigint", "double", "float")]
    expr = df.unpivot("cell_id", [F.col(f"`{m}`").cast("double").alias(m) for m in markers], "feature", "value")
    cells = df.select("cell_id", F.col(f"`{x}`").cast("double").alias("X"), F.col(f"`{y}`").cast("double").alias("Y"))
    return Dataset(cells.join(_totals(expr), "cell_id", "left"), expr)


def load_spatial_data(spark: SparkSession, filename: str | None = None, counts_file: str | None = None, coords_file: str | None = None, type: str = "auto") -> Dataset:
    """Dispatch by type, or by what is given: a saved dataset (two parquet tables), a measurement CSV, or two CSVs."""
    if type == "auto":
        if filename:
            type = "akoya" if filename.lower().endswith(".csv") else "parquet"
        elif counts_file and coords_file:
            type = "csv"
        else:
            raise ValueError("give a file, or both a counts and a coordinates file")
    if type == "parquet":
        return Dataset(spark.read.parquet(f"{filename}/cells"), spark.read.parquet(f"{filename}/expr"))
    if type == "akoya":
        return read_measurements(spark, filename)
    if type == "csv":
        return read_counts_coords(spark, counts_file, coords_file)
    raise ValueError(f"unknown type {type}")


def save_dataset(data: Dataset, path: str) -> None:
    data.cells.write.mode("overwrite").parquet(f"{path}/cells")
    data.expr.write.mode("overwrite").parquet(f"{path}/expr")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
