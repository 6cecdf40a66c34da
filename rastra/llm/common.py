"""Helpers shared by the text operators: shared storage, words, skewed joins."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything that is ASCII but not a digit or a letter becomes a space, A-Z become a-z.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: A-Z become a-z, all else stays.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_made: list[tuple[SparkSession, str]] = []


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters of UTF-8 data."""
    return data.translate(WORD_TABLE).split()


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own under /tmp; a
    cluster must name one, since no machine-local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return _qualified(spark, found).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file:///tmp/rastra-checkpoints-{os.getuid()}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, so that readers other than Spark find the same store."""
    if "://" in path:
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; all of them go when the application ends."""
    if not _made:
        atexit.register(release)
    path = f"{shared_dir(spark)}/rastra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete every scratch table made so far. DataFrames that read them become invalid."""
    while _made:
        spark, path = _made.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001, S110  the session may have stopped
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def about(rows: DataFrame, by: str, wanted: int, total: int) -> DataFrame:
    """Somewhat fewer than ``wanted`` of ``total`` rows, those of small hashes of a column; all rows if there are no more.

    Each row is judged by itself, so that no task gathers candidates of all others.
    """
    if total <= wanted:
        return rows
    share = max(0.0, wanted - 4 * wanted**0.5) / total
    return rows.filter(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < int(share * (1 << 40)))


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


#: A key is hot if it holds more than one row in so many; there can be no more hot keys than that.
HOT_SHARE = 100_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join to a table with one row a key, whose column ``rows`` tells how many rows of ``left`` each key has.

    Keys with over a thousand rows and over 1/100000 of all ``total`` rows go by
    a broadcast (there are at most 100000 such keys, whatever the size), so
    that no hot key meets in one task; the others by an ordinary join. ``how``
    is inner or left.
    """
    limit = max(1000, total // HOT_SHARE)
    hot = right.filter(F.col(rows) > limit)
    flag = unused(left, "hot")[0]
    flagged = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias(flag))), keys, "left")
    some = flagged.filter(F.col(flag)).drop(flag).join(F.broadcast(hot), keys, "inner")
    rest = flagged.filter(F.col(flag).isNull()).drop(flag).join(right.filter(F.col(rows) <= limit), keys, how)
    return some.unionByName(rest)
