"""Histograms of rasters: counting, equalising, matching, background."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 256


def histogram(pixels: DataFrame) -> DataFrame:
    """Counts of each level 0 to 255 over all images; level (int), n (long)."""
    spark = pixels.sparkSession
    counts = pixels.groupBy(F.col("v").cast("int").alias("level")).agg(F.count("*").alias("n"))
    every = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    return every.join(F.broadcast(counts), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def image_cdf(pixels: DataFrame) -> DataFrame:
    """image_id, v and the share c of pixels up to v, from one aggregate of at most 256 rows an image."""
    counts = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    image = Window.partitionBy("image_id")
    upto = image.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("image_id", "v", (F.sum("n").over(upto) / F.sum("n").over(image).cast("double")).alias("c"))


def equalize(pixels: DataFrame, bins: int = LEVELS) -> DataFrame:
    """Levels become their share c of their image, as one of ``bins`` evenly spaced levels from 0 to 255: round(255 * c) by default."""
    step = F.floor((bins - 1) * F.col("c") + 0.5)
    levels = image_cdf(pixels).select("image_id", "v", F.floor(step * 255 / (bins - 1) + 0.5).cast("long").alias("to"))
    return pixels.join(levels, ["image_id", "v"]).select("image_id", "row", "col", F.col("to").alias("v"))


def match(pixels: DataFrame, target: DataFrame) -> DataFrame:
    """Levels become those whose share in the target (level, n) is nearest to their own share; the least of equals.

    Only an image's levels meet the 256 target levels, never its pixels.
    """
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # over 256 rows
    shares = target.select(F.col("level").cast("long").alias("k"), (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()).cast("double")).alias("t"))
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("shares"))
    # distances are compared to 12 digits, so that equal ones tie
    far = F.transform("shares", lambda s: F.struct(F.abs(F.round(s["t"] - F.col("c"), 12)).alias("far"), s["k"].alias("k")))
    levels = image_cdf(pixels).join(F.broadcast(listed)).select("image_id", "v", F.array_min(far)["k"].alias("to"))
    return pixels.join(levels, ["image_id", "v"]).select("image_id", "row", "col", F.col("to").alias("v"))


def background(pixels: DataFrame) -> DataFrame:
    """The background level of each image and how many rows and columns at each edge show nothing else.

    The background is the first pixel's level if the first row or column shows
    one level only, else the last pixel's if the last row or column does, else
    there is none (bg null, all edges 0). An image of background alone has 0.
    """
    sized = pixels.join(pixels.groupBy("image_id").agg(F.max("row").alias("y1"), F.max("col").alias("x1")), "image_id")
    on = {"top": F.col("row") == 0, "left": F.col("col") == 0, "bottom": F.col("row") == F.col("y1"), "right": F.col("col") == F.col("x1")}
    solid = lambda c: F.max(F.when(c, F.col("v"))) == F.min(F.when(c, F.col("v")))
    edges = sized.groupBy("image_id").agg(
        (solid(on["top"]) | solid(on["left"])).alias("first"), (solid(on["bottom"]) | solid(on["right"])).alias("last"),
        F.max(F.when(on["top"] & on["left"], F.col("v"))).alias("first_v"), F.max(F.when(on["bottom"] & on["right"], F.col("v"))).alias("last_v"),
    )
    bg = edges.select("image_id", F.when(F.col("first"), F.col("first_v")).when(F.col("last"), F.col("last_v")).alias("bg"))
    fg = F.col("bg").isNotNull() & (F.col("v") != F.col("bg"))
    gap = lambda x: F.coalesce(F.min(F.when(fg, x)), F.lit(0))
    return sized.join(bg, "image_id").groupBy("image_id", "bg").agg(
        gap(F.col("row")).alias("t"), gap(F.col("col")).alias("l"), gap(F.col("y1") - F.col("row")).alias("b"), gap(F.col("x1") - F.col("col")).alias("r")
    )
