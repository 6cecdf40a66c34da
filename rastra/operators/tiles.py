"""Tiles with a halo, and what is done tile by tile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.operators.raster import with_size


def saturate(x: Column) -> Column:
    """Rounded half up and kept within 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("long")


def quantize(p: Column) -> Column:
    """A probability as a level of 0 to 255."""
    return saturate(p * 255).cast("smallint")


def tile_count(w: Column, h: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Tiles across and down; null where a size isn't positive."""
    ok = (w > 0) & (h > 0) & (bw > 0) & (bh > 0)
    return F.when(ok, F.ceil(w / bw)).cast("long"), F.when(ok, F.ceil(h / bh)).cast("long")


@dataclass(frozen=True)
class Grid:
    """Blocks of h x w, border included on each side; tiles are numbered from 1."""

    h: int
    w: int
    border_h: int = 0
    border_w: int = 0

    def __post_init__(self):
        if self.step_h <= 0 or self.step_w <= 0:
            raise ValueError("a block must be larger than twice its border")

    @property
    def step_h(self) -> int:
        return self.h - 2 * self.border_h

    @property
    def step_w(self) -> int:
        return self.w - 2 * self.border_w

    def assign(self, pixels: DataFrame) -> DataFrame:
        """Adds the tile whose core holds each pixel."""
        return pixels.withColumns({"tile_row": F.expr(f"row div {self.step_h} + 1"), "tile_col": F.expr(f"col div {self.step_w} + 1")})

    def _places(self, at: str, size: str, step: int, border: int, again: bool) -> Column:
        """(tile from 0, position in the block) wherever a pixel shows, by itself or reflected at an edge, or reflections ``again`` at the other.

        Tiles follow by integer division from each of the pixel's positions; no join.
        """
        x, n = F.col(at), F.col(size)
        whole = F.ceil(n / F.lit(step)) * step  # blocks are filled up beyond the image
        shown = F.array(x, -x - 1, 2 * n - 1 - x)
        if again:  # the reflected image repeats after twice its size
            times = F.sequence(F.floor(F.lit(-border) / (2 * n)), F.floor((whole + border) / (2 * n)) + 1)
            shown = F.flatten(F.transform(times, lambda k: F.array(2 * n * k + x, 2 * n * k - 1 - x)))
        shows = F.filter(shown, lambda p: (p >= -border) & (p < whole + border))
        first = lambda p: F.floor((p - border) / F.lit(step))
        tiles = lambda p: F.sequence(F.greatest(F.lit(0).cast("long"), first(p)), F.least(F.ceil(n / F.lit(step)) - 1, F.floor((p + border) / F.lit(step))))
        placed = F.flatten(F.transform(shows, lambda p: F.transform(tiles(p), lambda t: F.struct(t.alias("t"), (p - t * step + border).alias("at")))))
        return F.filter(placed, lambda s: (s["at"] >= 0) & (s["at"] < step + 2 * border))

    def halo(self, pixels: DataFrame, size: tuple[int, int] | None = None, again: bool = False) -> DataFrame:
        """image_id, tile_row, tile_col, y, x, v: every cell of every block, with reflection at the image's edges.

        ``size`` (height, width) is that of all images; by default each one's follows from its last pixels. Where the border
        and the filling of the last tiles are larger than the image, cells are lacking unless reflections are reflected ``again``.
        """
        df = with_size(pixels) if size is None else pixels.withColumns({"h": F.lit(size[0]).cast("long"), "w": F.lit(size[1]).cast("long")})
        df = df.withColumn("a", F.explode(self._places("row", "h", self.step_h, self.border_h, again)))
        df = df.withColumn("b", F.explode(self._places("col", "w", self.step_w, self.border_w, again)))
        return df.select(
            "image_id", (F.col("a.t") + 1).alias("tile_row"), (F.col("b.t") + 1).alias("tile_col"), F.col("a.at").alias("y"), F.col("b.at").alias("x"), "v", "h", "w"
        )

    def blocks(self, pixels: DataFrame, wanted: DataFrame | None = None, size: tuple[int, int] | None = None) -> DataFrame:
        """One row a tile, of those wanted (tile_row, tile_col; all by default): its number, the image's size and its block's values row by row.

        If the image lacks pixels of its size, ``data`` has only the cells that show one and ``at`` their numbers; else ``at`` is null.
        """
        shown = self.halo(pixels, size, again=True)
        if wanted is not None:
            shown = shown.join(F.broadcast(wanted.select("tile_row", "tile_col").distinct()), ["tile_row", "tile_col"], "left_semi")
        cells = F.array_sort(F.collect_list(F.struct((F.col("y") * self.w + F.col("x")).alias("k"), F.col("v").cast("double").alias("v"))))
        found, names = shown.groupBy("image_id", "tile_row", "tile_col", "h", "w").agg(cells.alias("cells")), ["image_id", "tile_row", "tile_col", "h", "w"]
        at = F.when(F.size("cells") < self.h * self.w, F.transform("cells", lambda s: s["k"]))
        return found.select(*names, F.transform("cells", lambda s: s["v"]).alias("data"), at.alias("at"))

    def block(self, tile: dict) -> np.ndarray:
        """The values of a row of ``blocks``, NaN where the image lacks a pixel."""
        out = np.full(self.h * self.w, np.nan)
        out[slice(None) if tile["at"] is None else tile["at"]] = tile["data"]
        return out.reshape(self.h, self.w)

    def selected(self, pixels: DataFrame, wanted: DataFrame) -> DataFrame:
        """The pixels in the cores of the wanted tiles; repeats and tiles outside do no harm."""
        return self.assign(pixels).join(F.broadcast(wanted.distinct()), ["tile_row", "tile_col"], "left_semi")

    def needed(self, pixels: DataFrame, tiles: list[tuple[int, int]]) -> DataFrame:
        """Only the pixels that some wanted tile's block can show: ranges for the scan, halo included."""
        cond = F.lit(False)
        for r, c in dict.fromkeys(tiles):
            y, x = (r - 1) * self.step_h, (c - 1) * self.step_w
            # a block's last cells may show pixels reflected at the far edge
            cond |= F.col("row").between(y - self.h, y + self.h) & F.col("col").between(x - self.w, x + self.w)
        return pixels.filter(cond)

    def with_max(self, pixels: DataFrame) -> DataFrame:
        return self.assign(pixels).withColumn("top", F.max("v").over(Window.partitionBy("image_id", "tile_row", "tile_col")))


def merge(rasters: DataFrame) -> DataFrame:
    """Saturating sum of rasters of one image."""
    return rasters.groupBy("image_id", "row", "col").agg(F.least(F.lit(255), F.sum("v")).cast("long").alias("v"))


def pixel_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing pixels by image; a pixel that one side lacks differs."""
    both = a.select("image_id", "row", "col", F.col("v").alias("a")).join(b.select("image_id", "row", "col", F.col("v").alias("b")), ["image_id", "row", "col"], "full")
    return both.groupBy("image_id").agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("differing"))


def with_level(pixels: DataFrame, coarse: DataFrame, levels: int, name: str = "up") -> DataFrame:
    """Adds the value that a raster ``levels`` coarser has for each pixel."""
    n = 2**levels
    up = coarse.select("image_id", F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("v").alias(name))
    df = pixels.withColumns({"__r": F.expr(f"row div {n}"), "__c": F.expr(f"col div {n}")})
    return df.join(up, ["image_id", "__r", "__c"]).drop("__r", "__c")
