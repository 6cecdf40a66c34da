"""Places of rows in a global order, without a task that sorts everything.

Rows are dealt to ranges of the order; a range is sorted by itself, and the
counts of earlier ranges shift its places. Where ranges begin is read off
Spark's own range partitioning of the order's columns alone, so that ranges
are alike in size whatever the values look like. The beginnings are at most one
row a range and travel as a literal, in which each row finds its range by
bisection.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, made of the names given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        found = f"__{name}"
        while found.lower() in taken:
            found += "_"
        taken.add(found.lower())
        out.append(found)
    return out


def range_starts(df: DataFrame, order: list[str], ranges: int) -> list:
    """The least values of each range, ascending, as rows; at most ``ranges``, which bounds what the driver gets."""
    part = unused(df, "part")[0]
    keys = df.select(*order).repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in order)).withColumn(part, F.spark_partition_id())
    starts = keys.groupBy(part).agg(F.min(F.struct(*order)).alias("least"))
    return [r.least for r in starts.orderBy("least").collect()]


def _plain(value):
    """A value as JSON tells it."""
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def range_of(df: DataFrame, order: list[str], starts: list) -> Column:
    """The number of the last range that starts at or before a row, from 0. Nulls come first."""
    if len(starts) < 2:
        return F.lit(0)
    fields = [T.StructField(c, df.schema[c].dataType) for c in order]
    listed = T.ArrayType(T.StructType(fields))
    values = json.dumps([dict(zip(order, map(_plain, row), strict=True)) for row in starts])
    held, own, n = F.from_json(F.lit(values), listed), F.struct(*order), len(starts)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    further = lambda at, step: F.when((at + step < n) & (F.get(held, at + step) <= own), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def ranked(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds the row's number from 0 by ascending ``order`` (nulls first), counted in each group of ``within``.

    The order's columns need not be distinct; which of equal rows comes first is
    open. A group, however large, is spread over ranges. There are as many
    ranges as shuffle partitions unless told otherwise.
    """
    spark, within = df.sparkSession, within or []
    keys = [*within, *order]
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, here, before = unused(df, "range", "here", "before")
    dealt = df.withColumn(part, range_of(df, keys, range_starts(df, keys, ranges)))
    counts = dealt.groupBy(*within, part).agg(F.count("*").alias(here))  # at most groups and ranges together
    earlier = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*within, part, F.coalesce(F.sum(here).over(earlier), F.lit(0)).alias(before))
    asc = [F.col(c).asc_nulls_first() for c in order]
    numbered = dealt.withColumn(here, F.row_number().over(Window.partitionBy(*within, part).orderBy(*asc)))
    left, right = numbered.alias("l"), shifts.alias("r")
    same = F.col(f"l.{part}") == F.col(f"r.{part}")
    for c in within:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    place = (F.col(f"r.{before}") + F.col(f"l.{here}") - 1).cast("long").alias(name)
    return left.join(right, same).select(*(F.col(f"l.`{c}`") for c in df.columns), place)
