"""Queries over lists of names, task lists and logs that derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.operators import tables, tiles
from rastra.plans.registry import query
from rastra.sources.fixtures import table


@query("SELECT DISTINCT name FROM (SELECT p_type AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation)")
def op_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    return tables.union_distinct([part.select(F.col("p_type").alias("name")), part.select(F.col("p_brand").alias("name")), nation.select(F.col("n_name").alias("name"))])


@query(
    "WITH have AS (SELECT 'slice' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '.png' AS name FROM orders), "
    "want AS (SELECT 'slice' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END || '.png' AS name FROM range(990, 1041) r(i)) "
    "SELECT name FROM want WHERE name IN (SELECT name FROM have)"
)
def op_numeric_pattern(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    digits = F.when(F.length(key) < 4, F.lpad(key, 4, "0")).otherwise(key)
    have = table(spark, d, "orders").select(F.concat(F.lit("slice"), digits, F.lit(".png")).alias("name"))
    patterns = spark.createDataFrame([("slice####.png;990-1040",), ("slice####.png;9-3",), ("plain.png",)], "pattern string")
    return tables.numbered_names(patterns, have)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
def op_wildcard_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.wildcard(table(spark, d, "part").select("p_partkey", "p_name"), "*a*e*", "p_name")


CONFIG = """WITH lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_no, CAST(l_orderkey AS VARCHAR) AS task, l_returnflag || l_linestatus || l_linenumber AS v, l_partkey, l_suppkey FROM lineitem
), n AS (SELECT task AS task_id, v, row_number() OVER (PARTITION BY task ORDER BY line_no, v, l_partkey, l_suppkey) AS ordinal FROM lines)"""


def _config(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    value = F.concat(F.col("l_orderkey").cast("string"), F.lit(":::"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    # lines of one number are told apart by what else they hold
    return li.select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.substring_index(value, ":::", -1).alias("v"), "l_partkey", "l_suppkey").alias("line_no"), value.alias("value"))


@query(f"{CONFIG} SELECT task_id, max(CASE WHEN ordinal = 1 THEN v END) AS v1, max(CASE WHEN ordinal = 2 THEN v END) AS v2, max(CASE WHEN ordinal = 3 THEN v END) AS v3 FROM n GROUP BY 1")
def op_config_pivot(spark: SparkSession, d: str) -> DataFrame:
    nth = lambda k: F.max(F.when(F.col("ordinal") == k, F.col("value"))).alias(f"v{k}")
    return tables.config_rows(_config(spark, d)).groupBy("task_id").agg(nth(1), nth(2), nth(3))


@query("SELECT CAST(max(l_orderkey) AS VARCHAR) AS jobs FROM lineitem")
def op_last_value(spark: SparkSession, d: str) -> DataFrame:
    return tables.last_key(_config(spark, d))


@query("SELECT page_id, 'out/' || regexp_extract(url, '[^/]+$') AS path FROM pages")
def op_output_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tables.output_path(F.col("url"), "out").alias("path"))


@query("SELECT CAST(max(l_linenumber) AS INTEGER) AS nstage FROM lineitem")
def op_infer_nstage(spark: SparkSession, d: str) -> DataFrame:
    """The largest stage among model file names."""
    names = table(spark, d, "lineitem").select(F.concat(F.lit("MODEL_level"), F.col("l_partkey") % 5, F.lit("_stage"), "l_linenumber", F.lit(".mat")).alias("name"))
    return tables.largest_stage(names)


LITERAL = "CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'F' WHEN 2 THEN cast(user_id AS string) WHEN 3 THEN concat('-', user_id, '.5') WHEN 4 THEN concat('[', user_id, ' 4;5,-1]') ELSE event_type END"


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'logical' WHEN 1 THEN 'logical' WHEN 2 THEN 'number' WHEN 3 THEN 'number' WHEN 4 THEN 'matrix' ELSE 'text' END AS kind, "
    "CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN user_id || '.000' WHEN 3 THEN '-' || user_id || '.500' WHEN 4 THEN user_id || '.000 4.000;5.000 -1.000' ELSE event_type END AS value FROM events"
)
def op_parse_literal(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "events").select("event_id", F.expr(LITERAL).alias("text"))
    kind, value = tables.parse_literal(F.col("text"))
    return texts.select("event_id", kind.alias("kind"), value.alias("value"))


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_partkey END AS h, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS w FROM "
    "(SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)"
)
def op_parse_size(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(p_size, 'x', p_partkey) ELSE concat('-', p_size, 'x') END").alias("t"))
    h, w = tables.parse_size(F.col("t"))
    return texts.select("p_partkey", h.alias("h"), w.alias("w"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN -p_size END AS tile_row, CASE WHEN p_partkey % 4 < 3 THEN p_partkey END AS tile_col FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def op_parse_tile(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 4 < 3 THEN concat(p_partkey, ',-', p_size) ELSE concat(p_partkey, 'x', p_size) END").alias("t"))
    r, c = tables.parse_tile(F.col("t"))
    return texts.select("p_partkey", r.alias("tile_row"), c.alias("tile_col"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 13 WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN 0 ELSE 14 END ELSE 0 END AS INTEGER) AS status FROM events")
def op_log_exit_code(spark: SparkSession, d: str) -> DataFrame:
    text = "CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN concat('(task ', event_id, ') x Duration: 3 Exit Code: ', user_id % 3) WHEN 3 THEN '(task 1) End Time: 5 Exit Code: 0' END"
    return table(spark, d, "events").select("event_id", F.expr(text).alias("log")).select("event_id", tables.exit_status(F.col("log")).alias("status"))


@query("WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS place FROM supplier), b AS (SELECT p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS place FROM part) SELECT place, s_name, p_name FROM a JOIN b USING (place)")
def op_zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts by their places in order of name."""
    s = tables.placed(table(spark, d, "supplier").select("s_name"), "s_name")
    p = table(spark, d, "part").select(F.concat("p_name", F.lit("\u0000"), F.lpad(F.col("p_partkey").cast("string"), 19, "0")).alias("name"), "p_name")
    return s.join(tables.placed(p, "name").drop("name"), "place").select("place", "s_name", "p_name")


GRID = "grid AS (SELECT p_partkey AS image, CAST(ceil((p_size + 20) / 16.0) AS BIGINT) AS tw, CAST(ceil((p_size * 2 + 10) / 16.0) AS BIGINT) AS th FROM part)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    w, h = tiles.tile_count(size + 20, size * 2 + 10, F.lit(16), F.lit(16))
    return table(spark, d, "part").select(F.col("p_partkey").alias("image"), w.alias("tiles_w"), h.alias("tiles_h"))


@query(f"WITH {GRID} SELECT image, tw AS tiles_w, th AS tiles_h FROM grid")
def op_tile_count(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@query(f"WITH {GRID} SELECT CAST(sum(tw * th) AS BIGINT) AS tiles, count(*) AS images FROM grid")
def op_tile_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost goes by the number of tiles."""
    return _grid(spark, d).agg(F.sum(F.col("tiles_w") * F.col("tiles_h")).alias("tiles"), F.count("*").alias("images"))


BATCHES = f"WITH {GRID}, t AS (SELECT image, c.i AS c, r.i AS r, tw * th - 1 - (c.i * th + r.i) AS back FROM grid, range(30) c(i), range(60) r(i) WHERE c.i < tw AND r.i < th), b AS (SELECT image, CAST(back // 5 AS BIGINT) AS batch, string_agg('-t ' || (c + 1) || ',' || (r + 1), ' ' ORDER BY back) AS tiles FROM t GROUP BY 1, 2)"


@query(f"{BATCHES} SELECT * FROM b")
def op_task_batches(spark: SparkSession, d: str) -> DataFrame:
    return tables.task_batches(_grid(spark, d), 5)


@query(
    f"{BATCHES} SELECT image, batch, o.i AS ordinal, CASE o.i WHEN 1 THEN 'in/' || image || '.png' WHEN 2 THEN 'model' WHEN 3 THEN '-o 0x0 ' || tiles ELSE 'out/' || image || '.png.tiles/' || batch || '.png' END AS value FROM b, range(1, 5) o(i)"
)
def op_tile_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The four config lines of each image's batches."""
    b = tables.task_batches(_grid(spark, d), 5)
    image, batch = F.col("image").cast("string"), F.col("batch").cast("string")
    lines = F.array(
        F.concat(F.lit("in/"), image, F.lit(".png")), F.lit("model"), F.concat(F.lit("-o 0x0 "), "tiles"),
        F.concat(F.lit("out/"), image, F.lit(".png.tiles/"), batch, F.lit(".png")),
    )
    return b.select("image", "batch", F.posexplode(lines).alias("n", "value")).select("image", "batch", (F.col("n") + 1).cast("long").alias("ordinal"), "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def op_failed_tasks(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.failed_tasks(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT user_id, max(event_id) + 1 AS next_iteration FROM events GROUP BY 1")
def op_next_iteration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("next_iteration"))


@query("SELECT row_number() OVER (ORDER BY name) AS task_id, name FROM (SELECT DISTINCT regexp_replace(p_type, '\\.tiles$', '') AS name FROM part WHERE p_type IS NOT NULL)")
def op_merge_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers the folders of tiles, without their suffix, in order of name."""
    folders = table(spark, d, "part").filter("p_type is not null").select(F.concat("p_type", F.lit(".tiles")).alias("path"))
    names = folders.select(F.regexp_replace("path", r"\.tiles$", "").alias("name")).distinct()
    return tables.placed(names, "name").select((F.col("place") + 1).alias("task_id"), "name")


@query(
    "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_totalprice < 50000 THEN 2 WHEN o_orderpriority LIKE '1%' THEN 3 WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END AS INTEGER) AS status FROM orders"
)
def op_task_status(spark: SparkSession, d: str) -> DataFrame:
    """The first test that a finished task fails, or 0."""
    return table(spark, d, "orders").select(
        "o_orderkey",
        tables.first_failed(
            F.col("o_orderstatus") != "O", F.col("o_totalprice") >= 50000, ~F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") % 7 != 0
        ).alias("status"),
    )


@query(
    "WITH e AS (SELECT s.i AS stage, l.i AS level FROM range(1, 8) s(i), range(0, 5) l(i)), p AS (SELECT DISTINCT l_linenumber AS stage, l_partkey % 5 AS level FROM lineitem WHERE NOT (l_linenumber >= 3 AND l_partkey % 5 >= 2)) "
    "SELECT stage, level FROM e ANTI JOIN p USING (stage, level) ORDER BY 1, 2 LIMIT 1"
)
def op_restart_point(spark: SparkSession, d: str) -> DataFrame:
    """The first step of a cascade that has left no result."""
    expected = spark.range(1, 8).select(F.col("id").alias("stage")).join(F.broadcast(spark.range(5).select(F.col("id").alias("level"))))
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("stage"), (F.col("l_partkey") % 5).alias("level"))
    return tables.restart_point(expected, li.filter("not (stage >= 3 and level >= 2)").distinct())
