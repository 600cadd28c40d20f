"""Views of cells, expression and gene sets over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def small_cells(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 1000
    return e.select(F.col("vec_id").alias("cell_id"), at(0).alias("X"), at(1).alias("Y"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("celltype"))


def large_cells(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("cell_id"),
        (F.col("o_totalprice") / 100).cast("double").alias("X"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("Y"),
        F.col("o_orderpriority").alias("celltype"),
        F.concat(F.lit("CN"), F.floor(F.col("o_totalprice") / 100000).cast("int").cast("string")).alias("cluster"),
    )


def dense_expression(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).where("pos BETWEEN 2 AND 11")
    return e.select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("prot"), F.col("pos").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))


def sparse_counts(spark: SparkSession, d: str) -> DataFrame:
    line = _read(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("cell_id"), F.concat(F.lit("prot"), (F.col("l_partkey") % 200).cast("string")).alias("feature")).agg(F.sum("l_quantity").cast("double").alias("value"))


def gene_sets(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    return p.select(F.concat(F.lit("DB"), (F.col("p_size") % 2).cast("string")).alias("database"), F.col("p_type").alias("term"), F.concat(F.lit("prot"), (F.col("p_partkey") % 200).cast("string")).alias("gene")).distinct()


def register_views(spark: SparkSession, d: str, prefix: str = "") -> list[str]:
    """The views by their names here, for ``spark.sql``."""
    made = (small_cells, large_cells, dense_expression, sparse_counts, gene_sets)
    for f in made:
        f(spark, d).createOrReplaceTempView(prefix + f.__name__)
    return [prefix + f.__name__ for f in made]


#: The same views for DuckDB, to be put in front of a query.
SQL = {
    "c1": "SELECT vec_id AS cell_id, embedding[1]::DOUBLE*1000 AS X, embedding[2]::DOUBLE*1000 AS Y, concat('T', label::VARCHAR) AS celltype FROM embeddings",
    "c2": "SELECT o_orderkey AS cell_id, (o_totalprice/100)::DOUBLE AS X, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS Y, o_orderpriority AS celltype, concat('CN', floor(o_totalprice/100000)::INT::VARCHAR) AS cluster FROM orders",
    "e1": "SELECT vec_id AS cell_id, concat('prot', i::VARCHAR) AS feature, embedding[i+1]::DOUBLE AS value FROM embeddings, range(2,12) r(i)",
    "e2": "SELECT l_orderkey AS cell_id, concat('prot', (l_partkey % 200)::VARCHAR) AS feature, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2",
    "gset": "SELECT DISTINCT concat('DB', (p_size % 2)::VARCHAR) AS database, p_type AS term, concat('prot', (p_partkey % 200)::VARCHAR) AS gene FROM part",
}
