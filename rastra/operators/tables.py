"""Operators on file lists, task lists and logs, all as columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.operators.ranges import ranked, unused

#: The form of a numbered pattern and of an exit code in a log.
NUMBERED = r"^([^#]*)(#+)([^#;]*);(\d+)-(\d+)$"
EXIT_CODE = r"Exit Code: (\d+)"


def union_distinct(lists: list[DataFrame]) -> DataFrame:
    """All entries of several lists, each once."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.distinct()


def numbered_names(patterns: DataFrame, existing: DataFrame, col: str = "pattern") -> DataFrame:
    """Names that a pattern such as ``a###.png;1-20`` stands for, zero-padded, as far as they exist; an empty range gives none."""
    part = lambda k: F.regexp_extract(col, NUMBERED, k)
    lo, hi = part(4).cast("long"), part(5).cast("long")
    spread = patterns.filter(F.col(col).rlike(NUMBERED) & (lo <= hi)).withColumn("__i", F.explode(F.sequence(lo, hi)))
    digits = F.col("__i").cast("string")
    name = F.concat(part(1), F.when(F.length(digits) >= F.length(part(2)), digits).otherwise(F.lpad(digits, F.length(part(2)), "0")), part(3))
    return spread.select(name.alias("name")).distinct().join(existing, "name", "left_semi")


def wildcard(names: DataFrame, pattern: str, col: str = "name") -> DataFrame:
    """Names that match a pattern in which * stands for any characters."""
    escaped = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    return names.filter(F.col(col).like(escaped))


def config_rows(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """Task lines ``id:::value``: task_id, ordinal (from 1, by line number) and value."""
    split = lines.select(F.split(value, ":::", 2).alias("s"), F.col(line_no).alias("line_no"))
    order = Window.partitionBy("task_id").orderBy("line_no")
    return split.select(F.get("s", F.lit(0)).alias("task_id"), F.get("s", F.lit(1)).alias("value"), "line_no").withColumn("ordinal", F.row_number().over(order))


def last_key(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """The key of the last line: a config's number of jobs."""
    return lines.agg(F.max_by(F.get(F.split(value, ":::", 2), F.lit(0)), line_no).alias("jobs"))


def output_path(path: Column, folder: str) -> Column:
    """The path's last component, in a folder."""
    return F.concat_ws("/", F.lit(folder), F.regexp_extract(path, "[^/]+$", 0))


def exit_status(log: Column) -> Column:
    """0 if a log tells exit code 0; 12 without a log, 13 without a code, 14 for other codes."""
    code = F.regexp_extract(log, EXIT_CODE, 1)
    return F.when(log.isNull(), 12).when(code == "", 13).when(code.cast("long") == 0, 0).otherwise(14)


def first_failed(*tests: Column) -> Column:
    """The number, from 1, of the first test that does not hold, or 0; a test that is null does not hold."""
    out = F.lit(0)
    for k, test in reversed(list(enumerate(tests, 1))):
        out = F.when(F.coalesce(test, F.lit(False)), out).otherwise(k)
    return out


def training_status(log: Column, model: Column, exit_code: Column) -> Column:
    """0 for a training that went well; else the first of: 1 no output, 2 no model, 3 no exit code, 4 another exit code than 0."""
    return first_failed(F.length(log) > 0, model, exit_code.isNotNull(), exit_code == 0)


def largest_stage(names: DataFrame, col: str = "name") -> DataFrame:
    """The largest stage among model file names, as ``nstage``; null without any."""
    return names.agg(F.max(F.regexp_extract(col, r"_stage(\d+)\.mat$", 1).try_cast("int")).alias("nstage"))


def parse_size(text: Column) -> tuple[Column, Column]:
    """Height and width of ``WxH``; a single number is a square; null if it is neither."""
    ok = text.rlike("^[0-9]+(x[0-9]+)?$")
    w, h = F.regexp_extract(text, "^([0-9]+)", 1), F.regexp_extract(text, "x([0-9]+)$", 1)
    return F.when(ok, F.when(h == "", w).otherwise(h).cast("long")), F.when(ok, w.cast("long"))


def parse_tile(text: Column) -> tuple[Column, Column]:
    """Row and column of a tile given as ``C,R``; null if it isn't one."""
    form = "^(-?[0-9]+),(-?[0-9]+)$"
    ok = text.rlike(form)
    return F.when(ok, F.regexp_extract(text, form, 2).cast("long")), F.when(ok, F.regexp_extract(text, form, 1).cast("long"))


def parse_literal(text: Column) -> tuple[Column, Column]:
    """The kind of a literal (logical, number, matrix or text) and its normal form: rows by ``;``, values by blanks."""
    low = F.lower(F.trim(text))
    inner = F.trim(F.regexp_extract(low, r"^\[(.*)\]$", 1))
    rows = F.transform(F.split(inner, r"\s*;\s*"), lambda r: F.array_join(F.transform(F.split(F.trim(r), r"[ ,]+"), _plain), " "))
    is_number = low.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$")
    logical = low.isin("t", "true", "f", "false")
    kind = F.when(logical, "logical").when(is_number, "number").when(low.rlike(r"^\[.*\]$"), "matrix").otherwise("text")
    value = (
        F.when(logical, F.when(low.isin("t", "true"), "1").otherwise("0"))
        .when(is_number, _plain(low))
        .when(low.rlike(r"^\[.*\]$"), F.array_join(rows, ";"))
        .otherwise(text)
    )
    return kind, value


def _plain(x: Column) -> Column:
    """A number's text with a fixed number of decimals."""
    return F.format_string("%.3f", x.cast("double"))


def zip_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs two lists by their place in sorted order: place, the key and, as ``<key>_2``, the other list's.

    Lists of different lengths are an error, as are empty ones.
    """
    n, m = left.count(), right.count()
    if n != m or not n:
        raise ValueError(f"lists of {n} and {m} rows do not pair; both must be as long, and not empty")
    return placed(left, key).join(placed(right.withColumnRenamed(key, f"{key}_2"), f"{key}_2"), "place")


def placed(df: DataFrame, key: str) -> DataFrame:
    """Adds ``place``, the row's number from 0 by ascending key (keys are distinct)."""
    return ranked(df, [key])


def task_batches(grid: DataFrame, per_task: int) -> DataFrame:
    """Batches of an image's tiles: listed by column and then row, and taken from the end.

    ``grid`` has image, tiles_w and tiles_h. A batch's number and tiles follow
    from arithmetic on the tile's number, without a sort.
    """
    n = F.col("tiles_w") * F.col("tiles_h")
    batches = grid.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / per_task) - 1)))
    last = n - 1 - F.col("batch") * per_task
    numbers = F.sequence(last, F.greatest(F.lit(0).cast("long"), last - per_task + 1), F.lit(-1).cast("long"))
    tile = lambda k: F.concat(F.lit("-t "), (F.floor(k / F.col("tiles_h")) + 1).cast("string"), F.lit(","), (k % F.col("tiles_h") + 1).cast("string"))
    return batches.select("image", "batch", F.array_join(F.transform(numbers, tile), " ").alias("tiles"))


def failed_tasks(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Expected tasks without a result."""
    return expected.join(produced.select(key).distinct(), key, "left_anti")


def restart_point(expected: DataFrame, present: DataFrame) -> DataFrame:
    """The first (stage, level) of those expected that isn't present; nulls if all are."""
    missing = expected.join(present, ["stage", "level"], "left_anti")
    return missing.agg(F.min(F.struct("stage", "level")).alias("m")).select("m.stage", "m.level")


def systematic_sample(rows: DataFrame, by: str, order: list[str], every: int = 10) -> DataFrame:
    """Every so many rows of each class, from its first one, in the given order."""
    n = unused(rows, "n")[0]
    return ranked(rows, order, [by], n).filter(F.col(n) % every == 0).drop(n)


def stratified_cap(rows: DataFrame, by: str, key: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows of each class: those of the least keys; nothing is dropped from smaller classes."""
    k, n = unused(rows, "k", "n")
    return ranked(rows.withColumn(k, key), [k], [by], n).filter(F.col(n) < cap).drop(k, n)
