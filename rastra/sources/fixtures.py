"""Rasters derived from the driver's tables, in long form: image_id, row, col, v."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grayscale images of 50 x 64: an image is 50 consecutive embeddings, a row of pixels one of them."""
    e = table(spark, sf_dir, "embeddings")
    level = F.floor((F.col("e").cast("double") + 0.6) * 212)
    return e.select(
        F.expr("vec_id div 50").alias("image_id"), (F.col("vec_id") % 50).alias("row"), F.posexplode("embedding").alias("col", "e")
    ).select("image_id", "row", F.col("col").cast("long").alias("col"), F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("long").alias("v"))


def labels(pixels: DataFrame, level: int = 150) -> DataFrame:
    """The raster with its label column y: 1 above the level."""
    return pixels.withColumn("y", (F.col("v") > level).cast("int"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix: id, f (array of doubles), y (1 for labels under 5)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"), (F.col("label") < 5).cast("int").alias("y"), "label")


#: The same rasters in DuckDB SQL.
PX_SQL = """px AS (
  SELECT vec_id // 50 AS image_id, vec_id % 50 AS "row", CAST(c.i AS BIGINT) AS col,
    CAST(least(255, greatest(0, floor((CAST(embedding[c.i + 1] AS DOUBLE) + 0.6) * 212))) AS BIGINT) AS v
  FROM embeddings, range(64) c(i)
)"""
