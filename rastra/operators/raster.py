"""Neighbourhood operators on rasters in long form (image_id, row, col, v; from 0, dense).

Neighbours come from window functions, first along columns and then along
rows: two shuffles for any number of offsets, and no join or exploded rows.
Windows are keyed by image and line, so one huge image spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Offset = tuple[int, int]  # dy, dx


def along_column():
    return Window.partitionBy("image_id", "col").orderBy("row")


def along_row():
    return Window.partitionBy("image_id", "row").orderBy("col")


def square_offsets(radius: int) -> list[Offset]:
    """All offsets of a square, x first."""
    return [(dy, dx) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]


def stencil_offsets(radius: int) -> list[Offset]:
    """A star: the row, the column and both diagonals, by y and then x."""
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if dy == 0 or dx == 0 or abs(dx) == abs(dy)]


def image_size(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))


def with_size(pixels: DataFrame) -> DataFrame:
    """Adds h and w, one row an image, by a join that Spark broadcasts while it is small."""
    return pixels.join(image_size(pixels), "image_id")


def _shift(col: str, by: int, window, fill: float | int | None) -> Column:
    return F.col(col) if by == 0 else (F.lead(col, by, fill) if by > 0 else F.lag(col, -by, fill)).over(window)


def shifted(pixels: DataFrame, offsets: Iterable[Offset], value: str = "v", fill: float | int | None = 0) -> tuple[DataFrame, list[Column]]:
    """The raster with helper columns, and for each offset the column of the neighbour's value (``fill`` outside)."""
    offsets = list(offsets)
    rows = sorted({dy for dy, _ in offsets})
    lines = {dy: f"__{value}_{dy}" for dy in rows}
    df = pixels.select("*", *(_shift(value, dy, along_column(), fill).alias(lines[dy]) for dy in rows))
    names = {o: f"__{value}_{o[0]}_{o[1]}" for o in set(offsets)}
    df = df.select("*", *(_shift(lines[dy], dx, along_row(), fill).alias(n) for (dy, dx), n in sorted(names.items())))
    return df, [F.col(names[o]) for o in offsets]


def gather(pixels: DataFrame, offsets: Iterable[Offset], boundary: str = "zero", value: str = "v") -> DataFrame:
    """image_id, row, col and the neighbours' values as an array in the offsets' order.

    ``boundary`` is interior (only pixels whose neighbours all exist), zero or
    replicate.
    """
    offsets = list(offsets)
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    if boundary == "replicate":
        padded = pad(pixels, reach, "replicate", value)
        df, cols = shifted(padded, offsets, value)
        return _inside(df, pixels).select("image_id", "row", "col", F.array(*cols).alias("f"))
    df, cols = shifted(pixels, offsets, value, 0 if boundary == "zero" else None)
    if boundary == "interior":
        df = with_size(df).filter((F.col("row") >= reach) & (F.col("col") >= reach) & (F.col("row") < F.col("h") - reach) & (F.col("col") < F.col("w") - reach))
    return df.select("image_id", "row", "col", F.array(*cols).alias("f"))


def _copies(at: Column, size: Column, r: int, how: str) -> Column:
    """The positions from -r to size + r - 1 that show the pixel at a position."""
    if how == "reflect":
        low, high = [F.when(at < r, -at - 1)], [F.when(at >= size - r, 2 * size - 1 - at)]
    else:
        low = [F.when(at == 0, F.lit(-k)) for k in range(1, r + 1)]
        high = [F.when(at == size - 1, size - 1 + k) for k in range(1, r + 1)]
    return F.filter(F.array(at, *low, *high), lambda x: x.isNotNull())


def pad(pixels: DataFrame, r: int, how: str = "reflect", value: str = "v") -> DataFrame:
    """Adds a border of r pixels on each side, at negative positions and beyond the size; r may not exceed the size.

    ``reflect`` repeats the edge pixel first; ``replicate`` repeats it alone.
    Each pixel gives its own copies, so nothing is joined but the sizes.
    """
    df = with_size(pixels).withColumn("row", F.explode(_copies(F.col("row"), F.col("h"), r, how)))
    return df.withColumn("col", F.explode(_copies(F.col("col"), F.col("w"), r, how))).select("image_id", "row", "col", value)


def _inside(df: DataFrame, pixels: DataFrame) -> DataFrame:
    """The rows of a padded raster that lie in the image."""
    return df.join(image_size(pixels), "image_id").filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("h")) & (F.col("col") < F.col("w")))


def correlate(pixels: DataFrame, kernels: dict[str, dict[Offset, float]], boundary: str = "zero", value: str = "v") -> DataFrame:
    """Adds for each named kernel the sum of its weights times the neighbours' values.

    ``boundary`` is zero, reflect or replicate. Kernels share their neighbours.
    """
    offsets = sorted({o for k in kernels.values() for o in k})
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    source = pixels if boundary == "zero" else pad(pixels, reach, boundary, value)
    df, cols = shifted(source, offsets, value)
    at = dict(zip(offsets, cols, strict=True))

    def total(kernel: dict[Offset, float]) -> Column:
        terms = [F.lit(w) * at[o] for o, w in sorted(kernel.items())]
        while len(terms) > 1:  # a balanced tree, since a long chain is slow to compile
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0]

    df = df.select("image_id", "row", "col", value, *(total(k).alias(n) for n, k in kernels.items()))
    return df if boundary == "zero" else _inside(df, pixels).select("image_id", "row", "col", value, *kernels)


def flipped(kernel: dict[Offset, float]) -> dict[Offset, float]:
    """A convolution with a kernel is the correlation with the flipped one."""
    return {(-dy, -dx): w for (dy, dx), w in kernel.items()}


def integral(pixels: DataFrame, value: str = "v", name: str = "s") -> DataFrame:
    """The sum over all pixels above and to the left, the pixel included."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    df = pixels.withColumn("__line", F.sum(value).over(upto(along_row())))
    return df.withColumn(name, F.sum("__line").over(upto(along_column()))).drop("__line")


def haar(pixels: DataFrame, size: int = 16) -> DataFrame:
    """Haar responses hx and hy of the size x size box around each pixel of the reflected image scaled to 0..1.

    With an integral image of the padded image, box sums are differences at
    corners; an image point at (row, col) has the box from (row, col) - size / 2.
    """
    r, mid = size // 2, (size + 1) // 2
    padded = pad(pixels.withColumn("x", F.col("v") / 255.0), r, "reflect", "x")
    summed = integral(padded, "x")
    low, high = -r, size - r
    corners = [(y, x) for y in (low, low + mid, high - mid, high) for x in (low, low + mid, high - mid, high)]
    df, cols = shifted(summed, dict.fromkeys(corners), "s", 0.0)
    at = dict(zip(dict.fromkeys(corners), cols, strict=True))
    box = lambda y0, x0, y1, x1: at[y1, x1] + at[y0, x0] - at[y0, x1] - at[y1, x0]
    area = box(low, low, high, high)
    part = lambda a, b: F.when(area > 0, (a - b) / (area + 1e-5)).otherwise(0.0)
    hx = part(box(low, low + mid, high, high), box(low, low, high, high - mid))
    hy = part(box(low + mid, low, high, high), box(low, low, high - mid, high))
    # beyond the padded image's last line there are no boxes: the last row and column lack theirs only outside the image
    return _inside(df.withColumns({"hx": hx, "hy": hy}), pixels).select("image_id", "row", "col", "hx", "hy")


#: Weights in 256ths of an antialiased bicubic reduction to half.
HALF_WEIGHTS = (-3, -9, 29, 111, 111, 29, -9, -3)


def even(pixels: DataFrame) -> DataFrame:
    """Repeats the last row or column of odd sizes."""
    twice = lambda at, size: F.when((at == size - 1) & (size % 2 == 1), F.array(at, at + 1)).otherwise(F.array(at))
    df = with_size(pixels).withColumn("row", F.explode(twice(F.col("row"), F.col("h"))))
    return df.withColumn("col", F.explode(twice(F.col("col"), F.col("w")))).select("image_id", "row", "col", "v")


def downsample(pixels: DataFrame, levels: int = 1) -> DataFrame:
    """Halves the size, by bicubic weights with mirrored edges, once for each level; whole numbers, 0 to 255."""
    for _ in range(levels):
        padded = pad(even(pixels), 4, "reflect")
        taps = lambda c, w: sum((F.lit(k) * _shift(c, d - 3, w, None) for d, k in enumerate(HALF_WEIGHTS)), F.lit(0))
        half = padded.withColumn("a", taps("v", along_column())).filter("a is not null and pmod(row, 2) = 0")
        full = half.withColumn("b", taps("a", along_row())).filter("b is not null and pmod(col, 2) = 0")
        level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("b") + 32768) / 65536))).cast("long")
        inner = full.filter("row >= 0 and col >= 0").join(image_size(even(pixels)), "image_id").filter("row < h and col < w")
        pixels = inner.select("image_id", F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col"), level.alias("v"))
    return pixels


def upsample(pixels: DataFrame, levels: int = 1, h: int | None = None, w: int | None = None) -> DataFrame:
    """Doubles the size by repetition for each level, then crops to h x w if given."""
    n = 2**levels
    ext = lambda c: F.explode(F.sequence(F.col(c) * n, F.col(c) * n + n - 1))
    df = pixels.withColumn("row", ext("row")).withColumn("col", ext("col"))
    if h is not None:
        df = df.filter(F.col("row") < h)
    return df.filter(F.col("col") < w) if w is not None else df


def maxpool(pixels: DataFrame, levels: int = 1, value: str = "v") -> DataFrame:
    """The largest value of each 2^levels square; missing pixels count as 0, so values may not be negative."""
    n = 2**levels
    return pixels.groupBy("image_id", F.expr(f"row div {n}").alias("row"), F.expr(f"col div {n}").alias("col")).agg(F.max(value).alias(value))


def fill_reflect(pixels: DataFrame, t: int, left: int, b: int, r: int) -> DataFrame:
    """Overwrites a border with the reflection of what it surrounds, rows first; the inner part must be at least as large.

    Each pixel inside is copied to where it is reflected; the border's old values are dropped.
    """
    at, size = F.col("row"), F.col("h")
    inner = with_size(pixels).filter((at >= t) & (at < size - b) & (F.col("col") >= left) & (F.col("col") < F.col("w") - r))

    def copies(at: Column, size: Column, lo: int, hi: int) -> Column:
        return F.filter(F.array(at, F.when(at < 2 * lo, 2 * lo - 1 - at), F.when(at >= size - 2 * hi, 2 * (size - hi) - 1 - at)), lambda x: x.isNotNull())

    df = inner.withColumn("row", F.explode(copies(at, size, t, b)))
    return df.withColumn("col", F.explode(copies(F.col("col"), F.col("w"), left, r))).select("image_id", "row", "col", "v")


def pad_zero(pixels: DataFrame, t: int, left: int, b: int, r: int) -> DataFrame:
    """Enlarges each image by a border of zeros: the image's rows move, the border's are made from the sizes."""
    sizes = image_size(pixels)
    grid = sizes.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") + t + b - 1)))
    outer = (F.col("row") < t) | (F.col("row") >= F.col("h") + t)
    cols = F.sequence(F.lit(0).cast("long"), F.col("w") + left + r - 1)
    sides = F.filter(cols, lambda c: outer | (c < left) | (c >= F.col("w") + left))
    border = grid.select("image_id", "row", F.explode(sides).alias("col"), F.lit(0).cast("long").alias("v"))
    return pixels.select("image_id", (F.col("row") + t).alias("row"), (F.col("col") + left).alias("col"), "v").unionByName(border)


def crop(pixels: DataFrame, t: int, left: int, b: int, r: int) -> DataFrame:
    df = with_size(pixels).filter((F.col("row") >= t) & (F.col("row") < F.col("h") - b) & (F.col("col") >= left) & (F.col("col") < F.col("w") - r))
    return df.select("image_id", (F.col("row") - t).alias("row"), (F.col("col") - left).alias("col"), "v")


def fill_zero(pixels: DataFrame, t: int, left: int, b: int, r: int) -> DataFrame:
    edge = (F.col("row") < t) | (F.col("row") >= F.col("h") - b) | (F.col("col") < left) | (F.col("col") >= F.col("w") - r)
    return with_size(pixels).select("image_id", "row", "col", F.when(edge, F.lit(0).cast("long")).otherwise(F.col("v")).alias("v"))
