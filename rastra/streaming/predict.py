"""Prediction of rasters as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rastra.operators.tiles import Grid
from rastra.plans.cascade import Model, Param, predict

SCHEMA = "image_id long, row long, col long, v long"


def predict_stream(spark: SparkSession, source: str, out: str, checkpoint: str, model: Model, param: Param, grid: Grid) -> StreamingQuery:
    """Predict each new Parquet file of whole images under ``source``; results go to ``out``, a folder a batch.

    A batch is overwritten if it is done again after a failure, so every image
    is there once.
    """
    arriving = spark.readStream.schema(SCHEMA).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        predict(batch, model, param, grid).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
