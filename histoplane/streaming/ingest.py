"""Cells that arrive as files: prepared and appended batch by batch, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.cells import prepare_data


def ingest_cells(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, id_col: str = "cell_id") -> None:
    """Takes what is new in ``source`` and ends. Preparation needs no state, so the file sink's own log makes each row appear once."""
    cells = prepare_data(spark.readStream.schema(schema).parquet(source), cell_id_col=id_col)
    cells.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
