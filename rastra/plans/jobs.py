"""Runs of many tasks: what is expected, what is there, what is tried again."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.operators.tables import failed_tasks
from rastra.operators.tables import task_batches as batches_of
from rastra.sources.text_files import task_lines

#: Results of a run of tasks.
DONE, RETRIES_EXCEEDED, SUBMIT_FAILED = 0, 1, 11


def run_tasks(tasks: DataFrame, work: Callable[[DataFrame, int], DataFrame], key: str = "task_id", max_tries: int = 3, log: Attempts | None = None) -> tuple[int, DataFrame]:
    """Run tasks until each has a result or the tries are used up; returns the outcome and the tasks still failed.

    ``work`` gets the tasks to do and the number of the try and returns the keys
    of those that have a result. Done tasks are never run again. With ``log``
    each try's failed tasks are kept.
    """
    todo = tasks
    for n in range(1, max_tries + 1):
        try:
            done = work(todo, n)
        except Exception:  # noqa: BLE001  a submission that fails as a whole
            return SUBMIT_FAILED, todo
        todo = failed_tasks(todo, done, key)
        if log:
            todo = log.add(n, todo)
        if not todo.limit(1).count():
            return DONE, todo
    return RETRIES_EXCEEDED, todo


class Attempts:
    """The failed tasks of each try, a folder a try; earlier tries stay as they are."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, attempt: int, failed: DataFrame) -> DataFrame:
        """Write a try's failed tasks, in place of an earlier run of the same try, and read them back."""
        path = f"{self.folder}/attempt={attempt}"
        failed.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(failed.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)


def attempts(failed: dict[int, DataFrame]) -> DataFrame:
    """The failed tasks of each try, as one append-only table."""
    out = None
    for n, df in sorted(failed.items()):
        one = df.withColumn("attempt", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def status(tasks: DataFrame, produced: DataFrame, key: str = "task_id") -> DataFrame:
    """Each task with ``state``: done if it has a result, else failed."""
    done = produced.select(key).distinct().withColumn("state", F.lit("done"))
    return tasks.join(done, key, "left").withColumn("state", F.coalesce("state", F.lit("failed")))


def verify(tasks: DataFrame, produced: DataFrame, key: str = "task_id") -> tuple[int, DataFrame]:
    """How many tasks have no result, and which."""
    failed = failed_tasks(tasks, produced, key)
    return failed.count(), failed


def predict_job(grid: DataFrame, per_task: int, model: str, folder: str, options: str = "") -> DataFrame:
    """Task lines of a prediction: image, model, options with the task's tiles, and output; ids from 1 by image and batch.

    ``grid`` has image, tiles_w and tiles_h. Ids follow from the images' numbers
    of batches, which are summed over one row an image.
    """
    per_image = grid.select("image", F.ceil(F.col("tiles_w") * F.col("tiles_h") / per_task).alias("n"))
    before = per_image.select("image", (F.sum("n").over(Window.orderBy("image").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    tasks = batches_of(grid, per_task).join(before, "image").select(
        (F.col("before") + F.col("batch") + 1).cast("long").alias("task_id"), "image", F.lit(model).alias("model"),
        F.trim(F.concat(F.lit(f"{options} "), F.col("tiles"))).alias("options"), F.concat(F.lit(f"{folder.rstrip('/')}/"), F.regexp_extract(F.col("image").cast("string"), "[^/]+$", 0)).alias("out"),
    )
    return task_lines(tasks, ["image", "model", "options", "out"])


def train_job(tasks: DataFrame) -> DataFrame:
    """Task lines of trainings: images, labels, options and output folder of each task_id."""
    return task_lines(tasks, ["images", "labels", "options", "out"])


def grouped(spark: SparkSession, group: str, work: Callable[[], object]) -> object:
    """Run work as a named group of jobs, which ``cancel`` can stop; its jobs' state is in ``running``."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def running(spark: SparkSession, group: str) -> dict[int, str]:
    """The states of a group's jobs by number."""
    tracker = spark.sparkContext.statusTracker()
    found = ((n, tracker.getJobInfo(n)) for n in tracker.getJobIdsForGroup(group))
    return {n: info.status for n, info in found if info is not None}


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def reported(work: Callable[[], object], say: Callable[[str], None] = print) -> int:
    """Run work, tell its seconds and, if it fails, the report; returns the exit code, 0 or 1."""
    began, code = time.time(), 0
    try:
        work()
    except Exception:  # noqa: BLE001  the report is what is wanted
        say(traceback.format_exc())
        code = 1
    say(f"Ran for {time.time() - began:.3f} seconds")
    return code


def tool_numbers(values: list[str], count: int) -> list[int]:
    """An image tool's whole numbers of at least 0; a wrong number of them, or another value, is an error."""
    if len(values) != count:
        raise ValueError(f"{count} values are wanted, not {len(values)}")
    if not all(v.isascii() and v.isdigit() for v in values):
        raise ValueError("values must be whole numbers of at least 0")
    return [int(v) for v in values]


def tool_histogram(lines: list[str], levels: int = 256) -> list[int]:
    """A histogram given as text: as many whole numbers as there are levels, by any white space."""
    return tool_numbers(" ".join(lines).split(), levels)
