"""Images as rasters: path specifications, PNG reading and writing without other libraries."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.operators import tiles
from rastra.operators.tables import NUMBERED

#: Suffixes of images, and the first bytes of a PNG file.
SUFFIXES = ("png", "tif", "tiff")
PNG = b"\x89PNG\r\n\x1a\n"
PATHS = "path string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def kind(spark: SparkSession, path: str) -> str | None:
    """dir, file or None."""
    fs, p = _fs(spark, path)
    if not path or not fs.exists(p):
        return None
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    fs, p = _fs(spark, folder)
    form = re.compile(pattern, re.I)
    names = [x.getPath().toString() for x in fs.listStatus(p) if x.isFile() and form.fullmatch(x.getPath().getName())]
    return spark.createDataFrame([(n,) for n in names], PATHS)


def expand(spark: SparkSession, spec: str | list[str]) -> DataFrame:
    """The files that a specification names, each once, sorted by path.

    A folder stands for its PNG and TIFF files, a file for itself. Else, in this
    order: a list by commas is the union of its parts; ``a###.png;1-20`` are
    numbered names that exist; * in the last part of a path matches any
    characters. A list of paths keeps those that exist. What fits nothing names
    nothing; a value that is no text raises TypeError.
    """
    if isinstance(spec, list):
        found = [s for s in spec if kind(spark, s)]
        return spark.createDataFrame([(s,) for s in found], PATHS).distinct().orderBy("path")
    if not isinstance(spec, str):
        raise TypeError("a path specification is a text or a list of texts")
    return _expand(spark, spec).distinct().orderBy("path")


def _expand(spark: SparkSession, spec: str) -> DataFrame:
    there = kind(spark, spec)
    if there == "dir":
        return _listing(spark, spec, rf".*\.({'|'.join(SUFFIXES)})")
    if there == "file":
        fs, p = _fs(spark, spec)
        return spark.createDataFrame([(fs.getFileStatus(p).getPath().toString(),)], PATHS)
    if "," in spec:
        return reduce(DataFrame.unionByName, (_expand(spark, s) for s in spec.split(",")))
    if m := re.match(NUMBERED, spec):
        head, hashes, tail, lo, hi = m.groups()
        names = [f"{head}{i:0{len(hashes)}d}{tail}" for i in range(int(lo), int(hi) + 1)]
        return spark.createDataFrame([(n,) for n in names if kind(spark, n) == "file"], PATHS)
    folder, _, name = spec.rpartition("/")
    if "*" in name and kind(spark, folder or ".") == "dir":
        return _listing(spark, folder or ".", ".*".join(re.escape(x) for x in name.split("*")))
    return spark.createDataFrame([], PATHS)


def decode_png(data: bytes) -> np.ndarray:
    """Levels of a PNG: 8 or 16 bits, gray (alpha dropped) or colour (averaged), not interlaced."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        if tag == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif tag == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlaced:
        raise ValueError("this kind of PNG is not supported")
    px = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * px)
    out = np.zeros((h, w * px), np.uint8)
    above = np.zeros(w * px, np.int64)
    for y in range(h):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = np.cumsum(line.reshape(w, px), axis=0).ravel() & 255
        elif how in (3, 4):
            for x in range(w * px):
                left = line[x - px] if x >= px else 0
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - px] if x >= px else 0
                    base = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v, base=base: abs(base - v))
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    pixels = out.view(">u2").astype(np.int64) if depth == 16 else out.astype(np.int64)
    pixels = pixels.reshape(h, w, channels)
    return pixels[:, :, 0] if channels < 3 else pixels[:, :, :3].sum(axis=2) // 3


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def _lines(img: np.ndarray) -> bytes:
    """An image's lines as PNG has them, each after the mark of no filter."""
    return np.concatenate([np.zeros((len(img), 1), np.uint8), img.astype(np.uint8)], axis=1).tobytes()


def pack_lines(lines: bytes) -> bytes:
    """Lines as a part of a deflate stream that others can follow."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(lines) + z.flush(zlib.Z_FULL_FLUSH)


def joined_checksum(parts: list[tuple[int, int]]) -> int:
    """Adler-32 of data from its parts' checksums and lengths."""
    a, b, base = 1, 0, 65521
    for check, n in parts:
        low, high = check & 0xFFFF, check >> 16
        b = (b + high + n * (a - 1)) % base
        a = (a + low - 1) % base
    return b << 16 | a


def png_of(h: int, w: int, strips: list[tuple[bytes, int, int]]) -> bytes:
    """An 8-bit gray PNG from its strips in order: packed lines, their checksum and their length."""
    check = struct.pack(">I", joined_checksum([(c, n) for _, c, n in strips]))
    body = b"".join([b"\x78\x9c", *(data for data, _, _ in strips), b"\x03\x00", check])
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def encode_png(img: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    lines = _lines(img)
    return png_of(*img.shape, [(pack_lines(lines), zlib.adler32(lines), len(lines))])


def png_size(data: bytes) -> tuple[int, int]:
    """Height and width from the header alone."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    w, h = struct.unpack_from(">II", data, 16)
    return h, w


def sizes(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, h and w of PNG images, of which only the first bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(_uri(path))
                with store.open_input_file(name) as f:
                    found.append(png_size(f.read(33)))
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("path"), *cols], ["path", "h", "w"])

    return paths.select("path").mapInArrow(run, "path string, h long, w long")


def _uri(path: str) -> str:
    """A path as others than Spark read it."""
    return re.sub("^file:/(?!/)", "file:///", path)


def first_size(spark: SparkSession, folder: str) -> tuple[int, int] | None:
    """Height and width of a folder's first PNG by name; None if it has none, as TIFF sizes cannot be read."""
    found = png_files(spark, folder).orderBy("path").limit(1)
    return next(((r.h, r.w) for r in sizes(spark, found).collect()), None)


def png_files(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's files that end in .png in lower case, as the image tools take them."""
    fs, p = _fs(spark, folder)
    names = [x.getPath().toString() for x in fs.listStatus(p) if x.isFile() and x.getPath().getName().endswith(".png")] if fs.exists(p) else []
    return spark.createDataFrame([(n,) for n in names], PATHS)


def scan(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, row, col, v of PNG images. Files are read by Spark, a partition at a time."""
    files = [r.path for r in paths.collect()]
    schema = "path string, row long, col long, v long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                img = decode_png(data)
                row, col = np.mgrid[: img.shape[0], : img.shape[1]].reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * img.size), *(pa.array(x) for x in (row, col, img.ravel()))], ["path", "row", "col", "v"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(run, schema)


#: Lines of an image that one task packs at a time.
STRIP = 64


def encoded(rasters: DataFrame) -> DataFrame:
    """image_id and png, an image's file; pixels are 0 where none is given.

    Strips of lines are packed by themselves, so that no row holds the pixels of
    a large image; only packed strips come together.
    """
    kind_ = rasters.schema["image_id"].dataType.simpleString()
    size = rasters.groupBy("image_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    lines = size.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / STRIP))))
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v").cast("long"))).cast("int")
    cells = rasters.groupBy("image_id", F.floor(F.col("row") / STRIP).alias("strip")).agg(F.collect_list(F.struct((F.col("row") % STRIP).cast("int").alias("row"), F.col("col").cast("int").alias("col"), level.alias("v"))).alias("cells"))
    strips = lines.join(cells, ["image_id", "strip"], "left").select("image_id", "strip", "h", "w", "cells")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                h, w, strip = (one.column(c)[0].as_py() for c in ("h", "w", "strip"))
                img, own = np.zeros((min(STRIP, h - strip * STRIP), w), np.uint8), one.column("cells").flatten()
                if len(own):
                    row, col, v = (x.to_numpy(zero_copy_only=False) for x in own.flatten())
                    img[row, col] = v
                data = _lines(img)
                cols = [one.column("image_id"), one.column("strip"), one.column("h"), one.column("w"), pa.array([pack_lines(data)]), pa.array([zlib.adler32(data)]), pa.array([len(data)])]
                yield pa.RecordBatch.from_arrays(cols, ["image_id", "strip", "h", "w", "data", "checksum", "length"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("strip")
        strips = list(zip(*(table.column(c).to_pylist() for c in ("data", "checksum", "length")), strict=True))
        png = png_of(table.column("h")[0].as_py(), table.column("w")[0].as_py(), strips)
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "png": pa.array([png], pa.binary())})

    packed = strips.mapInArrow(pack, f"image_id {kind_}, strip long, h long, w long, data binary, checksum long, length long")
    return packed.groupBy("image_id").applyInArrow(whole, f"image_id {kind_}, png binary")


def write(rasters: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Write each image as a PNG file under a shared folder; image_id, path and bytes of each, once all are written.

    ``names`` has image_id and name. A file that is written again, as after a
    lost executor, is the same file.
    """
    return _stored(encoded(rasters).join(names.select("image_id", "name"), "image_id").select("image_id", "name", "png"), folder)


def _stored(files: DataFrame, folder: str) -> DataFrame:
    """Write files (image_id, name, png) under a folder."""
    spark, kind_ = files.sparkSession, files.schema["image_id"].dataType.simpleString()
    fs, p = _fs(spark, folder)
    fs.mkdirs(p)
    base = _uri(fs.makeQualified(p).toString()).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as stores

        for b in batches:
            paths, sizes_ = [], []
            for name, png in zip(b.column("name").to_pylist(), b.column("png").to_pylist(), strict=True):
                paths.append(f"{base}/{name}")
                store, at = stores.FileSystem.from_uri(paths[-1])
                with store.open_output_stream(at) as f:
                    f.write(png)
                sizes_.append(len(png))
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(paths, pa.string()), pa.array(sizes_, pa.int64())], ["image_id", "path", "bytes"])

    schema = f"image_id {kind_}, path string, bytes long"
    return spark.createDataFrame(files.mapInArrow(run, schema).collect(), schema)  # a row for each image


def merge(spark: SparkSession, paths: DataFrame, name: str, folder: str) -> DataFrame:
    """Write the saturating sum of an image's tiles, PNG files of one size, as one file; a single tile is that file's content.

    No tile is an error, as are tiles of different sizes.
    """
    shapes = sizes(spark, paths).select("h", "w").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("tiles of different sizes" if shapes else "no tiles")
    one = tiles.merge(scan(spark, paths).withColumn("image_id", F.lit(0).cast("long")))
    return write(one, spark.createDataFrame([(0, name)], "image_id long, name string"), folder)


def transform(spark: SparkSession, paths: DataFrame, change, folder: str) -> DataFrame:
    """Apply a function of an image's levels (H x W to H x W) to each PNG and write the results under the same names."""
    schema = "path string, png binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(change(decode_png(x))) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], ["path", "png"])

    files = [r.path for r in paths.collect()]
    if not files:
        return spark.createDataFrame([], "image_id string, path string, bytes long")
    made = spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(run, schema)
    named = made.select(F.col("path").alias("image_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "png")
    return _stored(named, folder)
