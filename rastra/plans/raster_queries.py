"""Queries over the fixture raster: neighbourhoods, pyramids, histograms, tiles, features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.functions import kernels
from rastra.operators import histogram, raster, tiles
from rastra.plans.registry import query
from rastra.sources.fixtures import PX_SQL, labels, px

PX = f"WITH {PX_SQL}"
SIZES = "sizes AS (SELECT image_id, max(\"row\") + 1 AS h, max(col) + 1 AS w FROM px GROUP BY 1)"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def kernel_sql(name: str, kernel: dict) -> str:
    return f"{name}(dy, dx, w) AS (VALUES {values((y, x, float(w)) for (y, x), w in sorted(kernel.items()))})"


#: Index of the pixel that a reflected or clamped position shows.
REFLECT = "CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
CLAMP = "least({n} - 1, greatest(0, {i}))"


def correlate_sql(kernel: dict, how: str, source: str = "px", value: str = "v", sign: int = 1) -> str:
    """Sums of a kernel's weights times neighbours; rows image_id, row, col, s."""
    at = lambda c, d: f"p.{c} + ({sign} * k.{d})"
    y, x = at('"row"', "dy"), at("col", "dx")
    if how != "zero":
        form = REFLECT if how == "reflect" else CLAMP
        y, x = form.format(i=y, n="z.h"), form.format(i=x, n="z.w")
    return (
        f"SELECT p.image_id, p.\"row\", p.col, sum(coalesce(q.{value}, 0) * CAST(k.w AS DOUBLE)) AS s FROM {source} p JOIN sizes z USING (image_id) CROSS JOIN "
        f"(VALUES {values((b, a, float(w)) for (b, a), w in sorted(kernel.items()))}) k(dy, dx, w) "
        f"LEFT JOIN {source} q ON q.image_id = p.image_id AND q.\"row\" = {y} AND q.col = {x} GROUP BY 1, 2, 3"
    )


@query(f"{PX} SELECT * FROM px")
def op_scan_raster(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d)


@query(f"{PX}, {SIZES} SELECT * FROM sizes")
def op_image_size(spark: SparkSession, d: str) -> DataFrame:
    return raster.image_size(px(spark, d))


@query(f"{PX} SELECT image_id, \"row\", col, CAST(v > 150 AS INTEGER) AS y FROM px")
def op_binarize(spark: SparkSession, d: str) -> DataFrame:
    return labels(px(spark, d)).select("image_id", "row", "col", "y")


@query(f"{PX} SELECT image_id, \"row\", col, CAST(least(255, greatest(0, floor((v - 20) / 200.0 * 255 + 0.5))) AS SMALLINT) AS q FROM px")
def op_quantize(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).select("image_id", "row", "col", tiles.quantize((F.col("v") - 20) / 200.0).alias("q"))


@query(f"{PX} SELECT image_id, \"row\", col, CASE WHEN v > 0.3 * 255 THEN 255 ELSE 0 END AS bilevel FROM px")
def op_threshold(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).select("image_id", "row", "col", F.when(F.col("v") > 0.3 * 255, 255).otherwise(0).alias("bilevel"))


@query(
    f"{PX}, {SIZES}, grid AS (SELECT image_id, r.i AS \"row\", c.i AS col FROM sizes, range(70) r(i), range(80) c(i) WHERE r.i < h + 5 AND c.i < w + 9) "
    "SELECT g.image_id, g.\"row\", g.col, coalesce(v, 0) AS v FROM grid g LEFT JOIN px p ON p.image_id = g.image_id AND p.\"row\" = g.\"row\" - 2 AND p.col = g.col - 4"
)
def op_pad_zero(spark: SparkSession, d: str) -> DataFrame:
    return raster.pad_zero(px(spark, d), 2, 4, 3, 5)


@query(
    f"{PX}, {SIZES} SELECT image_id, \"row\" - 2 AS \"row\", col - 4 AS col, v FROM px JOIN sizes USING (image_id) "
    "WHERE \"row\" BETWEEN 2 AND h - 4 AND col BETWEEN 4 AND w - 6"
)
def op_crop(spark: SparkSession, d: str) -> DataFrame:
    return raster.crop(px(spark, d), 2, 4, 3, 5)


@query(
    f"{PX}, {SIZES} SELECT image_id, \"row\", col, CASE WHEN \"row\" BETWEEN 2 AND h - 4 AND col BETWEEN 4 AND w - 6 THEN v ELSE 0 END AS v "
    "FROM px JOIN sizes USING (image_id)"
)
def op_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    return raster.fill_zero(px(spark, d), 2, 4, 3, 5)


@query(
    f"{PX}, {SIZES} SELECT p.image_id, p.\"row\", p.col, q.v FROM px p JOIN sizes z USING (image_id) JOIN px q ON q.image_id = p.image_id "
    "AND q.\"row\" = CASE WHEN p.\"row\" < 2 THEN 3 - p.\"row\" WHEN p.\"row\" >= h - 3 THEN 2 * (h - 3) - 1 - p.\"row\" ELSE p.\"row\" END "
    "AND q.col = CASE WHEN p.col < 4 THEN 7 - p.col WHEN p.col >= w - 5 THEN 2 * (w - 5) - 1 - p.col ELSE p.col END"
)
def op_fill_reflect(spark: SparkSession, d: str) -> DataFrame:
    return raster.fill_reflect(px(spark, d), 2, 4, 3, 5)


def _offsets(spark: SparkSession, offsets) -> DataFrame:
    return spark.createDataFrame([(k, dx, dy) for k, (dy, dx) in enumerate(offsets)], "k long, dx long, dy long")


@query(
    "SELECT CAST(row_number() OVER (ORDER BY x.i, y.i) - 1 AS BIGINT) AS k, CAST(x.i AS BIGINT) AS dx, CAST(y.i AS BIGINT) AS dy "
    "FROM range(-3, 4) x(i), range(-3, 4) y(i)"
)
def op_square_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, raster.square_offsets(3))


@query(
    "SELECT CAST(row_number() OVER (ORDER BY y.i, x.i) - 1 AS BIGINT) AS k, CAST(x.i AS BIGINT) AS dx, CAST(y.i AS BIGINT) AS dy "
    "FROM range(-7, 8) x(i), range(-7, 8) y(i) WHERE x.i = 0 OR y.i = 0 OR abs(x.i) = abs(y.i)"
)
def op_stencil_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, raster.stencil_offsets(7))


def _gather_sql(offsets, how: str, source: str = "px", value: str = "v") -> str:
    pos = {"zero": "{i}", "reflect": REFLECT, "replicate": CLAMP}[how]
    y, x = pos.format(i='p."row" + k.dy', n="z.h"), pos.format(i="p.col + k.dx", n="z.w")
    return (
        f"SELECT p.image_id, p.\"row\", p.col, list(coalesce(q.{value}, 0) ORDER BY k.k) AS f FROM {source} p JOIN sizes z USING (image_id) "
        f"CROSS JOIN (VALUES {values((k, dy, dx) for k, (dy, dx) in enumerate(offsets))}) k(k, dy, dx) "
        f"LEFT JOIN {source} q ON q.image_id = p.image_id AND q.\"row\" = {y} AND q.col = {x} GROUP BY 1, 2, 3"
    )


@query(
    f"{PX}, {SIZES}, a AS ({_gather_sql(raster.stencil_offsets(2), 'zero')}), b AS ({_gather_sql(raster.stencil_offsets(2), 'replicate')}) "
    "SELECT 'zero' AS boundary, image_id, \"row\", col, array_to_string(f, ',') AS f FROM a UNION ALL "
    "SELECT 'replicate', image_id, \"row\", col, array_to_string(f, ',') FROM b UNION ALL "
    "SELECT 'interior', image_id, \"row\", col, array_to_string(f, ',') FROM a JOIN sizes USING (image_id) WHERE \"row\" BETWEEN 2 AND h - 3 AND col BETWEEN 2 AND w - 3"
)
def op_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    pixels, out = px(spark, d), None
    for how in ("interior", "zero", "replicate"):
        one = raster.gather(pixels, raster.stencil_offsets(2), how)
        one = one.select(F.lit(how).alias("boundary"), "image_id", "row", "col", F.concat_ws(",", F.transform("f", lambda x: x.cast("string"))).alias("f"))
        out = one if out is None else out.unionByName(one)
    return out


def _reflected(pixels: DataFrame, radius: int, value: str = "v") -> DataFrame:
    df, cols = raster.shifted(raster.pad(pixels, radius, "reflect", value), raster.stencil_offsets(radius), value)
    return raster._inside(df, pixels).select("image_id", "row", "col", F.array(*cols).alias("f"))


@query(
    f"{PX}, {SIZES}, a AS ({_gather_sql(raster.stencil_offsets(7), 'reflect')}) SELECT image_id, \"row\", col, array_to_string(f, ',') AS f FROM a"
)
def op_context_features(spark: SparkSession, d: str) -> DataFrame:
    found = _reflected(px(spark, d), 7)
    return found.select("image_id", "row", "col", F.concat_ws(",", F.transform("f", lambda x: x.cast("string"))).alias("f"))


@query(
    f"{PX}, {SIZES}, a AS ({_gather_sql(raster.stencil_offsets(10), 'reflect')}) "
    "SELECT image_id, \"row\", col, CAST(len(f) AS BIGINT) AS n, round(list_sum(list_transform(f, lambda x: x / 255.0)), 6) AS total, "
    "round(f[1] / 255.0, 6) AS first_value, round(f[81] / 255.0, 6) AS last_value FROM a"
)
def op_intensity_features(spark: SparkSession, d: str) -> DataFrame:
    """The 81 intensities of the radius-10 star around each pixel, told by their sum and ends."""
    found = _reflected(px(spark, d).withColumn("x", F.col("v") / 255.0), 10, "x")
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    return found.select(
        "image_id", "row", "col", F.size("f").cast("long").alias("n"), F.round(total, 6).alias("total"),
        F.round(F.get("f", F.lit(0)), 6).alias("first_value"), F.round(F.get("f", F.lit(80)), 6).alias("last_value"),
    )


@query(
    f"{PX}, {SIZES}, grid AS (SELECT image_id, h, w, r.i AS \"row\", c.i AS col FROM sizes, range(-7, 70) r(i), range(-7, 80) c(i) WHERE r.i < h + 7 AND c.i < w + 7) "
    f"SELECT g.image_id, g.\"row\", g.col, v FROM grid g JOIN px q ON q.image_id = g.image_id AND q.\"row\" = {REFLECT.format(i='g.row', n='g.h')} "
    f"AND q.col = {REFLECT.format(i='g.col', n='g.w')}"
)
def op_pad_reflect(spark: SparkSession, d: str) -> DataFrame:
    return raster.pad(px(spark, d), 7)


SHARPEN = {(-1, -1): 1.0, (-1, 0): -2.0, (-1, 1): 0.0, (0, -1): 3.0, (0, 0): 4.0, (0, 1): -1.0, (1, -1): 0.0, (1, 0): 2.0, (1, 1): -3.0}


@query(f"{PX}, {SIZES}, a AS ({correlate_sql(SHARPEN, 'zero', sign=-1)}) SELECT image_id, \"row\", col, round(s, 4) AS s FROM a")
def op_conv2d(spark: SparkSession, d: str) -> DataFrame:
    found = raster.correlate(px(spark, d), {"s": raster.flipped(SHARPEN)})
    return found.select("image_id", "row", "col", F.round("s", 4).alias("s"))


@query(
    f"{PX}, {SIZES}, a AS ({correlate_sql(SHARPEN, 'reflect')}) "
    "SELECT image_id, \"row\", col, CAST(least(255, greatest(0, floor(s + 0.5))) AS BIGINT) AS s FROM a"
)
def op_correlate_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """Correlation under reflection; like the image's class, the result is whole and within 0 to 255."""
    found = raster.correlate(px(spark, d), {"s": SHARPEN}, "reflect")
    return found.select("image_id", "row", "col", tiles.saturate(F.col("s")).alias("s"))


@query(f"{PX}, {SIZES}, a AS ({correlate_sql(kernels.gaussian(), 'replicate')}) SELECT image_id, \"row\", col, CAST(least(255, greatest(0, floor(round(s, 6) + 0.5))) AS BIGINT) AS s FROM a")
def op_gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    found = raster.correlate(px(spark, d), {"s": kernels.gaussian()}, "replicate")
    return found.select("image_id", "row", "col", tiles.saturate(F.round("s", 6)).alias("s"))


WEIGHTS = kernels.sift_weights()
# 'same' keeps the part from the kernel's middle, so tap i reaches i - 8 back
SEPARABLE = {(8 - i, 8 - j): a * b for i, a in enumerate(WEIGHTS) for j, b in enumerate(WEIGHTS) if a * b}


@query(f"{PX}, {SIZES}, a AS ({correlate_sql(SEPARABLE, 'zero')}) SELECT image_id, \"row\", col, round(s, 4) AS s FROM a")
def op_separable_conv(spark: SparkSession, d: str) -> DataFrame:
    """The bin weights along columns, then along rows."""
    down = raster.correlate(px(spark, d), {"a": {(8 - i, 0): w for i, w in enumerate(WEIGHTS) if w}})
    both = raster.correlate(down, {"s": {(0, 8 - i): w for i, w in enumerate(WEIGHTS) if w}}, value="a")
    return both.select("image_id", "row", "col", F.round("s", 4).alias("s"))


_HALF = (
    "taps(k, w) AS (VALUES " + values((k, w) for k, w in enumerate(raster.HALF_WEIGHTS)) + ")"
)


def _half_pass(source: str, out: str, line: str, size: str, kept: str) -> str:
    """Halves one axis: out has the kept axis, the halved one and the weighted sums s."""
    at = REFLECT.format(i="2 * g.y - 3 + t.k", n=f"(g.{size} + g.{size} % 2)")
    return (
        f"{out} AS (SELECT g.image_id, q.{kept}, g.y AS {line}, sum(t.w * q.v) AS v FROM "
        f"(SELECT image_id, {size}, r.i AS y FROM sizes, range(64) r(i) WHERE r.i < ({size} + 1) // 2) g CROSS JOIN taps t "
        f"JOIN {source} q ON q.image_id = g.image_id AND q.{line} = least(g.{size} - 1, {at}) GROUP BY 1, 2, 3)"
    )


@query(
    f"{PX}, {SIZES}, {_HALF}, {_half_pass('px', 'a', chr(34) + 'row' + chr(34), 'h', 'col')}, {_half_pass('a', 'b', 'col', 'w', chr(34) + 'row' + chr(34))} "
    "SELECT image_id, \"row\", col, CAST(least(255, greatest(0, floor((v + 32768) / 65536.0))) AS BIGINT) AS v FROM b"
)
def op_downsample(spark: SparkSession, d: str) -> DataFrame:
    return raster.downsample(px(spark, d))


@query(
    f"{PX} SELECT image_id, \"row\" * 4 + a.i AS \"row\", col * 4 + b.i AS col, v FROM px, range(4) a(i), range(4) b(i) WHERE \"row\" * 4 + a.i < 190 AND col * 4 + b.i < 250"
)
def op_upsample(spark: SparkSession, d: str) -> DataFrame:
    return raster.upsample(px(spark, d), 2, 190, 250)


@query(f"{PX} SELECT image_id, \"row\" // 4 AS \"row\", col // 4 AS col, max(CAST(v > 150 AS INTEGER)) AS y FROM px GROUP BY 1, 2, 3")
def op_maxpool(spark: SparkSession, d: str) -> DataFrame:
    return raster.maxpool(labels(px(spark, d)), 2, "y")


@query(
    f"{PX}, {SIZES} SELECT CAST(l.i AS BIGINT) AS level, CAST(sum(CAST(ceil(h / pow(2, l.i)) AS BIGINT) * CAST(ceil(w / pow(2, l.i)) AS BIGINT)) AS BIGINT) AS pixels "
    "FROM sizes, range(5) l(i) GROUP BY 1"
)
def op_pyramid_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pixels on each level of the pyramid over all images, from the sizes alone."""
    sizes = raster.image_size(px(spark, d)).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    half = lambda c: F.ceil(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    return sizes.groupBy("level").agg(F.sum(half("h") * half("w")).cast("long").alias("pixels"))


@query(
    f"{PX}, lines AS (SELECT *, sum(v) OVER (PARTITION BY image_id, \"row\" ORDER BY col) AS a FROM px) "
    "SELECT image_id, \"row\", col, CAST(sum(a) OVER (PARTITION BY image_id, col ORDER BY \"row\") AS BIGINT) AS s FROM lines"
)
def op_integral_image(spark: SparkSession, d: str) -> DataFrame:
    return raster.integral(px(spark, d)).select("image_id", "row", "col", "s")


def _haar_sql() -> str:
    # the box holds rows and columns from -7 to 8 around the pixel; its halves meet between 0 and 1
    at = {(y, x): 1.0 for y in range(-7, 9) for x in range(-7, 9)}
    sx = {k: 1.0 if k[1] > 0 else -1.0 for k in at}
    sy = {k: 1.0 if k[0] > 0 else -1.0 for k in at}
    part = lambda k: correlate_sql(k, "reflect", "scaled", "x")
    return (
        f"{PX}, {SIZES}, scaled AS (SELECT image_id, \"row\", col, v / 255.0 AS x FROM px), a AS ({part(at)}), x AS ({part(sx)}), y AS ({part(sy)}) "
        "SELECT image_id, \"row\", col, CASE WHEN a.s > 0 THEN round(x.s / (a.s + 1e-5), 5) ELSE 0 END + 0.0 AS hx, "
        "CASE WHEN a.s > 0 THEN round(y.s / (a.s + 1e-5), 5) ELSE 0 END + 0.0 AS hy FROM a JOIN x USING (image_id, \"row\", col) JOIN y USING (image_id, \"row\", col)"
    )


@query(_haar_sql())
def op_haar(spark: SparkSession, d: str) -> DataFrame:
    found = raster.haar(px(spark, d))
    return found.select("image_id", "row", "col", (F.round("hx", 5) + 0.0).alias("hx"), (F.round("hy", 5) + 0.0).alias("hy"))


EDGES = (kernels.edge(math.pi / 2), kernels.edge(0.0))


@query(
    f"{PX}, {SIZES}, scaled AS (SELECT image_id, \"row\", col, v / 255.0 AS x FROM px), a AS ({correlate_sql(EDGES[0], 'zero', 'scaled', 'x', -1)}), "
    f"b AS ({correlate_sql(EDGES[1], 'zero', 'scaled', 'x', -1)}) SELECT image_id, \"row\", col, round(sqrt(a.s * a.s + b.s * b.s), 6) AS e FROM a JOIN b USING (image_id, \"row\", col)"
)
def op_edge_magnitude(spark: SparkSession, d: str) -> DataFrame:
    scaled = px(spark, d).withColumn("x", F.col("v") / 255.0)
    found = raster.correlate(scaled, {"a": raster.flipped(EDGES[0]), "b": raster.flipped(EDGES[1])}, value="x")
    return found.select("image_id", "row", "col", F.round(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), 6).alias("e"))


PAIR = (kernels.gabor(2, math.pi / 6, 4, 0), kernels.gabor(2, math.pi / 6, 4, math.pi / 2))
_LEVEL = "least(255, greatest(0, floor(round({}.s, 6) + 0.5))) / 255.0"


@query(
    f"{PX}, {SIZES}, a AS ({correlate_sql(PAIR[0], 'reflect')}), b AS ({correlate_sql(PAIR[1], 'reflect')}) "
    f"SELECT image_id, \"row\", col, round(sqrt(pow({_LEVEL.format('a')}, 2) + pow({_LEVEL.format('b')}, 2)), 6) AS energy FROM a JOIN b USING (image_id, \"row\", col)"
)
def op_gabor_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy of the bank's first quadrature pair; responses are whole and within 0 to 255 before they are scaled."""
    found = raster.correlate(px(spark, d), {"a": PAIR[0], "b": PAIR[1]}, "reflect")
    a, b = (tiles.saturate(F.round(c, 6)) / 255.0 for c in "ab")
    return found.select("image_id", "row", "col", F.round(F.sqrt(a * a + b * b), 6).alias("energy"))


SLOPES = kernels.gradient_of_gaussian()


def _orientation_sql() -> str:
    angles = ", ".join(
        f"round(pow(greatest(0, cos(t) * {math.cos(a * math.pi / 4)!r} + sin(t) * {math.sin(a * math.pi / 4)!r}), 9) * m, 6) AS o{a}" for a in range(8)
    )
    return (
        f"{PX}, {SIZES}, top AS (SELECT image_id, max(v) AS m FROM px GROUP BY 1), scaled AS (SELECT image_id, \"row\", col, v / CAST(m AS DOUBLE) AS x FROM px JOIN top USING (image_id)), "
        f"a AS ({correlate_sql(SLOPES[0], 'zero', 'scaled', 'x')}), b AS ({correlate_sql(SLOPES[1], 'zero', 'scaled', 'x')}), "
        "g AS (SELECT image_id, \"row\", col, sqrt(a.s * a.s + b.s * b.s) AS m, atan2(b.s, a.s) AS t FROM a JOIN b USING (image_id, \"row\", col)) "
        f"SELECT image_id, \"row\", col, {angles} FROM g"
    )


@query(_orientation_sql())
def op_orientation_energy(spark: SparkSession, d: str) -> DataFrame:
    """Gradient magnitude shared out to eight orientations by the ninth power of the cosine; images are divided by their largest value."""
    pixels = px(spark, d)
    top = pixels.groupBy("image_id").agg(F.max("v").cast("double").alias("m"))
    scaled = pixels.join(top, "image_id").withColumn("x", F.when(F.col("m") > 0, F.col("v") / F.col("m")).otherwise(0.0))
    g = raster.correlate(scaled.drop("m"), {"a": SLOPES[0], "b": SLOPES[1]}, value="x")
    g = g.select("image_id", "row", "col", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("m"), F.atan2("b", "a").alias("t"))
    share = lambda a: F.pow(F.greatest(F.lit(0.0), F.cos("t") * math.cos(a * math.pi / 4) + F.sin("t") * math.sin(a * math.pi / 4)), F.lit(9.0))
    return g.select("image_id", "row", "col", *(F.round(share(a) * F.col("m"), 6).alias(f"o{a}") for a in range(8)))


@query(f"{PX}, levels AS (SELECT CAST(i AS INTEGER) AS level FROM range(256) r(i)) SELECT level, count(px.v) AS n FROM levels LEFT JOIN px ON px.v = level GROUP BY 1")
def op_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram.histogram(px(spark, d))


@query(
    f"{PX}, counts AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2), cdf AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS c FROM counts) "
    "SELECT image_id, \"row\", col, CAST(floor(255 * c + 0.5) AS BIGINT) AS v FROM px JOIN cdf USING (image_id, v)"
)
def op_hist_equalize(spark: SparkSession, d: str) -> DataFrame:
    return histogram.equalize(px(spark, d))


@query(
    f"{PX}, levels AS (SELECT i AS k FROM range(256) r(i)), target AS (SELECT k, sum(coalesce(n, 0)) OVER (ORDER BY k) / CAST(sum(n) OVER () AS DOUBLE) AS t FROM levels LEFT JOIN (SELECT v, count(*) AS n FROM px GROUP BY 1) c ON c.v = k), "
    "counts AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY 1, 2), cdf AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS c FROM counts), "
    "best AS (SELECT image_id, v, arg_min(k, abs(round(t - c, 12)) * 1000 + k * 1e-9) AS k FROM cdf CROSS JOIN target GROUP BY 1, 2) "
    "SELECT image_id, \"row\", col, CAST(k AS BIGINT) AS v FROM px JOIN best USING (image_id, v)"
)
def op_hist_match(spark: SparkSession, d: str) -> DataFrame:
    """Each image is matched to the histogram of all."""
    pixels = px(spark, d)
    return histogram.match(pixels, histogram.histogram(pixels))


@query(
    f"{PX}, z AS (SELECT image_id, \"row\", col, CASE WHEN image_id % 2 = 0 AND (\"row\" < 3 OR col >= 60 OR \"row\" >= 48 OR col < 2) THEN 0 ELSE v END AS v FROM px), "
    "s AS (SELECT image_id, max(\"row\") + 1 AS h, max(col) + 1 AS w FROM z GROUP BY 1), "
    "e AS (SELECT image_id, max(CASE WHEN \"row\" = 0 THEN v END) - min(CASE WHEN \"row\" = 0 THEN v END) AS r0, max(CASE WHEN col = 0 THEN v END) - min(CASE WHEN col = 0 THEN v END) AS c0, "
    "max(CASE WHEN \"row\" = h - 1 THEN v END) - min(CASE WHEN \"row\" = h - 1 THEN v END) AS r1, max(CASE WHEN col = w - 1 THEN v END) - min(CASE WHEN col = w - 1 THEN v END) AS c1, "
    "max(CASE WHEN \"row\" = 0 AND col = 0 THEN v END) AS first_v, max(CASE WHEN \"row\" = h - 1 AND col = w - 1 THEN v END) AS last_v FROM z JOIN s USING (image_id) GROUP BY 1), "
    "b AS (SELECT image_id, CASE WHEN r0 = 0 OR c0 = 0 THEN first_v WHEN r1 = 0 OR c1 = 0 THEN last_v END AS bg FROM e) "
    "SELECT image_id, bg, coalesce(min(CASE WHEN bg IS NOT NULL AND v <> bg THEN \"row\" END), 0) AS t, coalesce(min(CASE WHEN bg IS NOT NULL AND v <> bg THEN col END), 0) AS l, "
    "coalesce(min(CASE WHEN bg IS NOT NULL AND v <> bg THEN h - 1 - \"row\" END), 0) AS b, coalesce(min(CASE WHEN bg IS NOT NULL AND v <> bg THEN w - 1 - col END), 0) AS r "
    "FROM z JOIN s USING (image_id) JOIN b USING (image_id) GROUP BY 1, 2"
)
def op_background_bbox(spark: SparkSession, d: str) -> DataFrame:
    edge = (F.col("image_id") % 2 == 0) & ((F.col("row") < 3) | (F.col("col") >= 60) | (F.col("row") >= 48) | (F.col("col") < 2))
    return histogram.background(px(spark, d).withColumn("v", F.when(edge, F.lit(0).cast("long")).otherwise(F.col("v"))))


@query(f"{PX} SELECT CAST(v > 150 AS INTEGER) AS y, count(*) AS n FROM px GROUP BY 1")
def op_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels(px(spark, d)).groupBy("y").agg(F.count("*").alias("n"))


@query(
    f"{PX} SELECT image_id, CAST(sum(CASE WHEN v <> (v // 3) * 3 THEN 1 ELSE 0 END) AS BIGINT) AS differing FROM px GROUP BY 1"
)
def op_pixel_diff(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in which a raster differs from its coarser copy."""
    pixels = px(spark, d)
    return tiles.pixel_diff(pixels, pixels.withColumn("v", F.expr("(v div 3) * 3")))


TILE = tiles.Grid(26, 26, 5, 5)


@query(f"{PX} SELECT image_id, \"row\", col, \"row\" // 16 + 1 AS tile_row, col // 16 + 1 AS tile_col FROM px")
def op_tile_assign(spark: SparkSession, d: str) -> DataFrame:
    return TILE.assign(px(spark, d)).select("image_id", "row", "col", "tile_row", "tile_col")


@query(
    f"{PX}, {SIZES}, grid AS (SELECT image_id, h, w, CAST(a.i AS BIGINT) AS tr, CAST(b.i AS BIGINT) AS tc FROM sizes, range(10) a(i), range(10) b(i) WHERE a.i * 16 < h AND b.i * 16 < w), "
    "cells AS (SELECT image_id, h, w, tr, tc, y.i AS y, x.i AS x, tr * 16 - 5 + y.i AS r, tc * 16 - 5 + x.i AS c FROM grid, range(26) y(i), range(26) x(i)) "
    f"SELECT g.image_id, tr + 1 AS tile_row, tc + 1 AS tile_col, CAST(count(*) AS BIGINT) AS cells, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 26 + x + 1)) AS BIGINT) AS moment "
    f"FROM cells g JOIN px q ON q.image_id = g.image_id AND q.\"row\" = {REFLECT.format(i='g.r', n='g.h')} AND q.col = {REFLECT.format(i='g.c', n='g.w')} GROUP BY 1, 2, 3"
)
def op_halo_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with their halo, told by the sum of their pixels and its moment."""
    halo = TILE.halo(px(spark, d))
    return halo.groupBy("image_id", "tile_row", "tile_col").agg(
        F.count("*").alias("cells"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("y") * 26 + F.col("x") + 1)).alias("moment")
    )


@query(
    f"{PX} SELECT image_id, \"row\", col, CASE WHEN (\"row\" // 16 + 1, col // 16 + 1) IN ((1, 1), (3, 2), (9, 9)) THEN v ELSE 0 END AS v FROM px"
)
def op_tile_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Only the requested tiles are computed; the rest of the output is zero."""
    wanted = spark.createDataFrame([(1, 1), (3, 2), (1, 1), (9, 9)], "tile_row long, tile_col long")
    pixels = px(spark, d)
    done = TILE.selected(pixels, wanted).select("image_id", "row", "col", F.col("v").alias("done"))
    return pixels.join(done, ["image_id", "row", "col"], "left").select("image_id", "row", "col", F.coalesce("done", F.lit(0)).alias("v"))


@query(f"{PX} SELECT image_id, \"row\", col, v, max(v) OVER (PARTITION BY image_id, \"row\" // 16, col // 16) AS top FROM px")
def op_tile_max(spark: SparkSession, d: str) -> DataFrame:
    return TILE.with_max(px(spark, d)).select("image_id", "row", "col", "v", "top")


@query(
    f"{PX}, layers AS (SELECT image_id % 2 AS image_id, \"row\", col, v FROM px) SELECT image_id, \"row\", col, CAST(least(255, sum(v)) AS BIGINT) AS v FROM layers GROUP BY 1, 2, 3"
)
def op_merge_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of one size are laid over one another by saturating sums."""
    return tiles.merge(px(spark, d).withColumn("image_id", F.col("image_id") % 2))


@query(
    f"{PX}, coarse AS (SELECT image_id, \"row\" // 4 AS r4, col // 4 AS c4, max(v) AS up FROM px GROUP BY 1, 2, 3) "
    "SELECT image_id, \"row\", col, v, up FROM px JOIN coarse USING (image_id) WHERE r4 = \"row\" // 4 AND c4 = col // 4"
)
def op_level_join(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with the value that a coarser level has for them."""
    pixels = px(spark, d)
    return tiles.with_level(pixels, raster.maxpool(pixels, 2), 2).select("image_id", "row", "col", "v", "up")
