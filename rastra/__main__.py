"""python -m rastra fit|predict|show: the cascade on folders of PNG images."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rastra.operators.histogram import match
from rastra.operators.tables import placed
from rastra.operators.tiles import Grid
from rastra.plans import cascade
from rastra.sources import images


# fixed values: the options' letters and the forms of sizes (WxH or one number) and tiles (C,R)


def size(text: str) -> tuple[int, int]:
    """Height and width of WxH or one number."""
    m = re.fullmatch(r"([0-9]+)(?:x([0-9]+))?", text)
    if not m:
        raise argparse.ArgumentTypeError(f"{text} is no size")
    return int(m[2] or m[1]), int(m[1])


def block(text: str) -> tuple[int, int]:
    h, w = size(text)
    if not h or not w:
        raise argparse.ArgumentTypeError("a block must not be empty")
    return h, w


def tile(text: str) -> tuple[int, int]:
    """Row and column of a tile given as C,R."""
    m = re.fullmatch(r"(-?[0-9]+),(-?[0-9]+)", text)
    if not m:
        raise argparse.ArgumentTypeError(f"{text} is no tile")
    return int(m[2]), int(m[1])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rastra")
    sub = p.add_subparsers(dest="do", required=True)
    fit = sub.add_parser("fit", help="fit a cascade on images and label images, which pair by their sorted order")
    fit.add_argument("images")
    fit.add_argument("labels")
    fit.add_argument("-m", "--model", default="./temp")
    fit.add_argument("-S", "--stages", type=int, default=2)
    fit.add_argument("-L", "--levels", type=int, default=4)
    fit.add_argument("-r", "--restart", action="store_true")
    pred = sub.add_parser("predict", help="write probability maps as PNG files of the images' names")
    pred.add_argument("images")
    pred.add_argument("out")
    pred.add_argument("-m", "--model", default="./temp")
    pred.add_argument("-b", "--block", type=block, default=(500, 500))
    pred.add_argument("-o", "--overlap", type=size, default=(50, 50))
    pred.add_argument("-t", "--tile", type=tile, action="append", default=[], help="only this tile, as C,R; all else is black")
    pred.add_argument("-n", "--no-match", action="store_true", help="the images' histograms already match the training images'")
    pred.add_argument("-p", "--parquet", action="store_true", help="write image_id, row, col, p and level q instead")
    show = sub.add_parser("show", help="tell what a model's folder holds")
    show.add_argument("-m", "--model", default="./temp")
    return p


def numbered(spark: SparkSession, spec: str):
    """image_id by sorted path with the path; and image_id, row, col, v."""
    paths = images.expand(spark, spec)
    ids = placed(paths.select("path"), "path").select("path", F.col("place").alias("image_id"))
    return ids, images.scan(spark, paths).join(ids, "path").select("image_id", "row", "col", "v")


def run_fit(spark: SparkSession, a: argparse.Namespace) -> None:
    (ids, pixels), (label_ids, marks) = numbered(spark, a.images), numbered(spark, a.labels)
    n, m = ids.count(), label_ids.count()
    if n != m or not n:
        raise SystemExit("there must be as many label images as images, and at least one")
    param = cascade.Param(a.stages, a.levels)
    marks = marks.select("image_id", "row", "col", (F.col("v") > 0).cast("int").alias("y"))
    cascade.save_param(spark, param, a.model, pixels)
    cascade.fit(pixels.join(marks, ["image_id", "row", "col"]), param, a.model, a.restart)


def run_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    known = cascade.load_param(spark, a.model)
    param = cascade.Param(known.stages, known.levels, tuple(known.extractors or cascade.Param().extractors))
    schema = "stage int, level int, groups int, width int, weights array<double>, errors array<double>"
    model = cascade.load(spark.read.schema(schema).parquet(*(f"{a.model}/stage={s}/level={v}" for s, v in param.steps())))
    ids, pixels = numbered(spark, a.images)
    if known.hgram and not a.no_match:
        pixels = match(pixels, spark.createDataFrame(list(enumerate(known.hgram)), "level int, n long"))
    found = cascade.predict(pixels, model, param, Grid(*a.block, *a.overlap), a.tile or None)
    if a.parquet:
        found.write.mode("overwrite").parquet(a.out)
    else:
        names = ids.select("image_id", F.concat(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), F.lit(".png")).alias("name"))
        images.write(found.select("image_id", "row", "col", F.col("q").cast("long").alias("v")), names, a.out)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rastra").getOrCreate()
    if a.do == "show":
        print("\n".join(cascade.describe_param(spark, a.model)))
    else:
        {"fit": run_fit, "predict": run_predict}[a.do](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
