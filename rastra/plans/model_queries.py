"""Queries over the fixture vectors: clustering, discriminants, scoring, measures, sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.functions import kernels
from rastra.operators import model, tables
from rastra.plans.registry import query
from rastra.sources.fixtures import vectors

VEC = """WITH vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f, CAST(label < 5 AS INTEGER) AS y, label FROM embeddings),
lv AS (SELECT id, y, label, CAST(i.i AS INTEGER) AS i, f[i.i + 1] AS x FROM vec, range(64) i(i)),
centres AS (SELECT label AS k, list(m ORDER BY i) AS m FROM (SELECT label, i, round(avg(x), 8) AS m FROM lv GROUP BY 1, 2) GROUP BY 1)"""

MODEL = f"""{VEC}, pairs AS (SELECT p.k AS g, n.k - 5 AS d, list_transform(list_zip(p.m, n.m), lambda z: z[1] - z[2]) AS diff, list_transform(list_zip(p.m, n.m), lambda z: (z[1] + z[2]) / 2) AS mid
  FROM centres p, centres n WHERE p.k < 5 AND n.k >= 5),
unit AS (SELECT g, d, mid, list_transform(diff, lambda x: x / sqrt(list_dot_product(diff, diff))) AS w FROM pairs),
disc AS (SELECT g, d, w, -list_dot_product(w, mid) AS b FROM unit),
sig AS (SELECT id, y, f, g, d, 1 / (1 + exp(-(list_dot_product(f, w) + b))) AS s FROM vec, disc)"""


def centres(vec: DataFrame) -> DataFrame:
    return model.means(vec, "label", 8)


def discriminants(vec: DataFrame) -> DataFrame:
    c = centres(vec)
    return model.discriminants(c.filter("k < 5"), c.filter("k >= 5").withColumn("k", F.col("k") - 5))


def scored(spark: SparkSession, d: str, root: bool = False) -> DataFrame:
    vec = vectors(spark, d)
    return model.and_or(vec, discriminants(vec), root)


@query(f"{MODEL}, a AS (SELECT id, g, product(s) AS s FROM sig GROUP BY 1, 2) SELECT id, round(1 - product(1 - s), 6) AS p FROM a GROUP BY 1")
def op_andor_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", F.round("p", 6).alias("p"))


@query(f"{MODEL}, a AS (SELECT id, g, sqrt(product(s)) AS s FROM sig GROUP BY 1, 2) SELECT id, round(1 - sqrt(product(1 - s)), 6) AS p FROM a GROUP BY 1")
def op_andor_score_sqrt(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, True).select("id", F.round("p", 6).alias("p"))


@query(f"{MODEL} SELECT g, d, round(b, 6) AS b, round(w[1], 6) AS w_first, round(list_sum(w), 6) AS w_sum FROM disc")
def op_discriminant_init(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return discriminants(vectors(spark, d)).select(
        "g", "d", F.round("b", 6).alias("b"), F.round(F.get("w", F.lit(0)), 6).alias("w_first"), F.round(total, 6).alias("w_sum")
    )


@query(f"{VEC} SELECT id, k, round(list_sum(list_transform(list_zip(f, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d2 FROM vec, centres")
def op_pairwise_dist(spark: SparkSession, d: str) -> DataFrame:
    vec = vectors(spark, d)
    return model.distances(vec, centres(vec)).select("id", "k", F.round("d2", 6).alias("d2"))


NEAREST = "SELECT id, arg_min(k, d2) AS k, min(d2) AS d2 FROM (SELECT id, k, list_sum(list_transform(list_zip(f, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM vec, {c}) GROUP BY 1"


@query(f"{VEC} SELECT id, k, round(d2, 6) AS d2 FROM ({NEAREST.format(c='centres')})")
def op_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    vec = vectors(spark, d)
    return model.nearest(vec.select("id", "f"), centres(vec)).select("id", "k", F.round("d2", 6).alias("d2"))


@query(f"{VEC} SELECT label AS k, i, round(avg(x), 6) AS m FROM lv GROUP BY 1, 2")
def op_cluster_means(spark: SparkSession, d: str) -> DataFrame:
    return model.means(vectors(spark, d), "label").select("k", F.posexplode("m").alias("i", "m")).select("k", "i", F.round("m", 6).alias("m"))


@query(f"{VEC} SELECT round(sqrt(avg(d2)), 6) AS rms, count(*) AS n FROM ({NEAREST.format(c='centres')})")
def op_kmeans_rms(spark: SparkSession, d: str) -> DataFrame:
    vec = vectors(spark, d)
    return model.nearest(vec.select("id", "f"), centres(vec)).agg(F.round(F.sqrt(F.avg("d2")), 6).alias("rms"), F.count("*").alias("n"))


def _step_sql(rounds: int) -> str:
    sql = f"{VEC}, c0 AS (SELECT CAST(id AS INTEGER) AS k, f AS m FROM vec WHERE id < 4)"
    for n in range(rounds):
        sql += (
            f", n{n} AS ({NEAREST.format(c=f'c{n}')}), c{n + 1} AS (SELECT k, list(m ORDER BY i) AS m FROM "
            f"(SELECT n.k, i, avg(x) AS m FROM lv JOIN n{n} n USING (id) GROUP BY 1, 2) GROUP BY 1)"
        )
    return f"{sql} SELECT k, CAST(i.i AS INTEGER) AS i, round(m[i.i + 1], 5) AS m FROM c{rounds}, range(64) i(i)"


def _steps(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    vec = vectors(spark, d).select("id", "f")
    c = vec.filter("id < 4").select(F.col("id").cast("int").alias("k"), F.col("f").alias("m"))  # the first guess, not a sample
    for _ in range(rounds):
        c = model.kmeans_step(vec, c)
    return c.select("k", F.posexplode("m").alias("i", "m")).select("k", "i", F.round("m", 5).alias("m"))


@query(_step_sql(1))
def op_kmeans_step1(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, 1)


@query(_step_sql(2))
def op_kmeans_step2(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d, 2)


@query()
def op_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters; each row's cluster and squared distance."""
    vec = vectors(spark, d).select("id", "f")
    return model.nearest(vec, model.kmeans(vec, 10)).select("id", "k", F.round("d2", 6).alias("d2"))


P = f"{MODEL}, a AS (SELECT id, y, g, product(s) AS s FROM sig GROUP BY 1, 2, 3), score AS (SELECT id, y, 1 - product(1 - s) AS p FROM a GROUP BY 1, 2)"


@query(f"{P} SELECT round(sqrt(avg(pow(0.1 + 0.8 * y - p, 2))), 6) AS rms FROM score")
def op_rms_error(spark: SparkSession, d: str) -> DataFrame:
    err = model.target(F.col("y")) - F.col("p")
    return scored(spark, d).agg(F.round(F.sqrt(F.avg(err * err)), 6).alias("rms"))


@query(
    f"{P}, c AS (SELECT CAST(sum(CAST(p > 0.13 AND y = 1 AS INTEGER)) AS BIGINT) AS tp, CAST(sum(CAST(p > 0.13 AND y = 0 AS INTEGER)) AS BIGINT) AS fp, "
    "CAST(sum(CAST(p <= 0.13 AND y = 1 AS INTEGER)) AS BIGINT) AS fn, CAST(sum(CAST(p <= 0.13 AND y = 0 AS INTEGER)) AS BIGINT) AS tn FROM score) "
    "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f_value, round(sqrt((tp / (tp + fn)) * (tn / (tn + fp))), 6) AS g_mean FROM c"
)
def op_confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = model.confusion(scored(spark, d), threshold=0.13)
    return found.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "f_value", "g_mean")))


@query(
    f"{MODEL}, a AS (SELECT id, y, g, product(s) AS a FROM sig GROUP BY 1, 2, 3), o AS (SELECT id, y, product(1 - a) AS none FROM a GROUP BY 1, 2), "
    "t AS (SELECT sig.id, sig.g, sig.d, none / (1 - a) * a * (0.1 + 0.8 * o.y - (1 - none)) * (1 - s) AS t FROM sig JOIN a USING (id, g) JOIN o ON o.id = sig.id), "
    "x AS (SELECT id, i, x FROM lv UNION ALL SELECT id, 64, 1.0 FROM vec) SELECT CAST(g AS INTEGER) AS g, CAST(d AS INTEGER) AS d, CAST(i AS INTEGER) AS i, round(sum(x * t), 4) + 0.0 AS s FROM t JOIN x USING (id) GROUP BY 1, 2, 3"
)
def op_andor_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The update sums with all rows as one batch."""
    vec = vectors(spark, d)
    return model.gradient(vec, discriminants(vec)).select("g", "d", "i", (F.round("s", 4) + 0.0).alias("s"))


@query(
    f"{VEC}, s AS (SELECT id, list_transform(f, lambda x: x * 3) AS f FROM vec), n AS (SELECT id, f, sqrt(list_dot_product(f, f)) AS n FROM s), "
    "c AS (SELECT id, f, n, list_transform(f, lambda x: least(x / n, 0.2)) AS c FROM n), "
    "r AS (SELECT id, CASE WHEN n > 1 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE f END AS f FROM c) "
    "SELECT id, CAST(i.i AS INTEGER) AS i, round(f[i.i + 1], 6) + 0.0 AS x FROM r, range(64) i(i)"
)
def op_vector_clip_normalize(spark: SparkSession, d: str) -> DataFrame:
    scaled = vectors(spark, d).select("id", F.transform("f", lambda x: x * 3).alias("f"))
    return scaled.select("id", F.posexplode(model.clip_normalize(F.col("f"))).alias("i", "x")).select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(f"{VEC}, n AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) AS n FROM vec) SELECT id, y FROM n WHERE (n - 1) % 10 = 0")
def op_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return tables.systematic_sample(vectors(spark, d).select("id", "y"), "y", ["id"])


@query(f"{VEC}, n AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY (id * 7919) % 10007, id) AS n FROM vec) SELECT id, y FROM n WHERE n <= 100")
def op_stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 100 rows of each class, by a fixed key in place of a random one."""
    key = F.struct((F.col("id") * 7919 % 10007).alias("a"), F.col("id").alias("b"))
    return tables.stratified_cap(vectors(spark, d).select("id", "y"), "y", key, 100)


@query(f"{VEC} SELECT id, y, (id * 7919) % 10007 % 10 = 0 AS validation FROM vec")
def op_validation_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a flag for the tenth that is kept for validation, by a fixed key in place of a random one."""
    return vectors(spark, d).select("id", "y", (F.col("id") * 7919 % 10007 % 10 == 0).alias("validation"))


def _kernel_frame(spark: SparkSession, named: dict) -> DataFrame:
    rows = [(n, dy, dx, w) for n, k in named.items() for (dy, dx), w in sorted(k.items())]
    return spark.createDataFrame(rows, "name string, dy long, dx long, w double").select("name", "dy", "dx", (F.round("w", 9) + 0.0).alias("w"))


@query(
    "WITH o AS (SELECT CAST(y.i AS BIGINT) AS dy, CAST(x.i AS BIGINT) AS dx FROM range(-3, 4) y(i), range(-3, 4) x(i)), g AS (SELECT dy, dx, exp(-(dx * dx + dy * dy) / 2.0) AS w FROM o), "
    "e AS (SELECT dy, dx, exp(-dx * dx / 2.0) / sqrt(2 * pi()) * (-dy) * exp(-dy * dy / 2.0) / sqrt(2 * pi()) AS w FROM o) "
    "SELECT 'gaussian' AS name, dy, dx, round(w / sum(w) OVER (), 9) + 0.0 AS w FROM g UNION ALL SELECT 'edge', dy, dx, round(w / sqrt(sum(w * w) OVER ()), 9) + 0.0 FROM e"
)
def op_gauss_kernel(spark: SparkSession, d: str) -> DataFrame:
    return _kernel_frame(spark, {"gaussian": kernels.gaussian(), "edge": kernels.edge(0.0)})


@query(
    "WITH o AS (SELECT CAST(y.i AS BIGINT) AS dy, CAST(x.i AS BIGINT) AS dx FROM range(-6, 7) y(i), range(-6, 7) x(i)), "
    "r AS (SELECT dy, dx, dx * cos(pi() / 6) + dy * sin(pi() / 6) AS u, -dx * sin(pi() / 6) + dy * cos(pi() / 6) AS v FROM o) "
    "SELECT 'gabor' AS name, dy, dx, round(exp(-0.5 * (u * u / 4 + v * v / 4)) * cos(2 * pi() / 4 * u), 9) + 0.0 AS w FROM r"
)
def op_gabor_kernel(spark: SparkSession, d: str) -> DataFrame:
    return _kernel_frame(spark, {"gabor": kernels.gabor(2, math.pi / 6, 4, 0)})
