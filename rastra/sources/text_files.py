"""Histograms, properties and task lines as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text file."""
    return [r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file; one that is there is replaced."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray("".join(f"{line}\n" for line in lines), "utf-8"))
    finally:
        out.close()


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """level and n: the first number of each line, the first line being level 0."""
    found = [int(line.split()[0]) for line in read_lines(spark, path) if line.strip()]
    return spark.createDataFrame(list(enumerate(found)), "level int, n long")


def write_histogram(counts: DataFrame, path: str | None = None) -> list[str]:
    """The counts (level, n) by level, one a line, to a file or, without one, to standard output."""
    lines = [str(r.n) for r in counts.select("level", "n").orderBy("level").collect()]  # 256 rows
    if path is None:
        print("\n".join(lines))
    else:
        write_lines(counts.sparkSession, path, lines)
    return lines


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and those that begin with # are none, and a later key holds. A missing file is an error."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} not found")
    lines = (line.strip() for line in read_lines(spark, path))
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if line and not line.startswith("#") and "=" in line)}


def command(properties: dict[str, str], folder_key: str, name: str) -> str:
    """A program's name under the folder that a property names; the name alone if it names none."""
    folder = properties.get(folder_key, "")
    return f"{folder.rstrip('/')}/{name}" if folder else name


def full_path(spark: SparkSession, path: str) -> str:
    """The absolute path, with its store, without . and .. parts."""
    fs, p = _path(spark, path)
    whole = fs.makeQualified(p)
    parts: list[str] = []
    for part in whole.toUri().getPath().split("/"):
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    scheme = whole.toUri().getScheme()
    return f"{scheme}://{whole.toUri().getAuthority() or ''}/{'/'.join(parts)}"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder; a missing path is an error."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"{path} not found")
    return fs.getContentSummary(p).getLength()


def task_lines(tasks: DataFrame, columns: list[str]) -> DataFrame:
    """``id:::value`` lines, one for each of the columns of each task (task_id), in order of id; line_no counts from 1."""
    values = F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("k", "value")
    rows = tasks.select("task_id", values)
    line_no = (F.col("task_id").cast("long") - 1) * len(columns) + F.col("k") + 1
    return rows.select(line_no.alias("line_no"), F.concat(F.col("task_id").cast("string"), F.lit(":::"), F.coalesce("value", F.lit(""))).alias("value"))
