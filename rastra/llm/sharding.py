"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals become small Parquet shards, which never change. A manifest lists the
live shards with their sizes; each append or compaction commits the next
manifest by one rename, so readers see a version or the next, never a mixture.
A commit that a rival has overtaken is made anew on the rival's version.
Compaction takes the tiers of sizes in ascending order; a tier with enough
shards is merged into files of the target size. Spark's own packing of small
files into read partitions does the merging: it takes files of like size
together up to the target, so rows are read and written once, without a shuffle.

An arrival has a shard for each task that wrote it, so shards follow the bytes
read, not the rows. The driver holds the paths of the shards that are read, as
Spark's own file listing does: at the target size some 800,000 for 100 TB.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastra.llm.common import unused
from rastra.llm.versions import Versions

MANIFEST = "path string, bytes long, run string, arrival long"


class ShardStore:
    """A table of immutable shards at a root folder that all executors share.

    The first append sets the columns; later ones must have the same names and
    types, in any order, or are refused. Any column name will do. Nulls, empty
    and long texts, equal rows and rows in any order are stored as they are. An
    arrival without rows is a commit without shards. ``shard_rows`` splits
    arrivals' shards by rows as well; 0 does not.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan: int = 4, shard_rows: int = 0):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan, self.shard_rows = target_bytes, fan, shard_rows
        self.versions = Versions(spark, f"{self.root}/manifests")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the last by default; no rows before the first commit."""
        version = self.versions.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.versions.at(version))

    def _files(self, folder: str, run: str, arrival: int) -> DataFrame:
        """The shards that a run has written. Only paths and sizes are read, not contents."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        return found.select("path", F.col("length").alias("bytes"), F.lit(run).alias("run"), F.lit(arrival).cast("long").alias("arrival"))

    def _commit(self, change) -> int:
        """Commit what ``change`` makes of the last manifest; it gets that and the new version's number."""

        def write(last: int, staged: str) -> None:
            shards = change(self.manifest(last), last + 1).select(*T._parse_datatype_string(MANIFEST).names)
            shards.repartition(1 + shards.count() // 1_000_000).write.parquet(staged)

        return self.versions.update(write)

    def append(self, rows: DataFrame) -> int:
        """Write rows as small shards and commit them; returns the new version."""
        lot = unused(rows, "lot")[0]
        return self.append_all(rows.withColumn(lot, F.lit(0)), lot)

    def append_all(self, rows: DataFrame, arrival_col: str) -> int:
        """Append several arrivals, in ascending order of an integer column, which isn't stored; nulls come first.

        One pass writes the shards of all; each arrival is then a commit of its own.
        """
        run, part = uuid.uuid4().hex[:12], unused(rows, "part")[0]
        folder = f"{self.root}/data/{run}"
        own = rows.drop(arrival_col)
        kept = self._schema(own)
        shape = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s)
        if shape(kept) != shape(own.schema):
            raise ValueError(f"the table has {kept.simpleString()}, the arrival {own.schema.simpleString()}")
        out = rows.withColumn(part, F.col(f"`{arrival_col}`")).drop(arrival_col).write.partitionBy(part)
        (out.option("maxRecordsPerFile", self.shard_rows) if self.shard_rows else out).parquet(folder)
        arrivals, version = self._folders(folder, part), 0
        if not arrivals:
            return self._commit(lambda old, _: old)
        for name in arrivals:
            version = self._commit(lambda old, new, name=name: old.unionByName(self._files(f"{folder}/{part}={name}", run, new)))
        return version

    def _folders(self, folder: str, part: str) -> list[str]:
        path = self.versions._path(folder)
        names = [x.getPath().getName() for x in path.getFileSystem(self.versions._conf).listStatus(path)]
        return sorted((n.partition("=")[2] for n in names if n.startswith(f"{part}=")), key=lambda n: (n.lstrip("-").isdigit(), int(n) if n.lstrip("-").isdigit() else 0))

    def _schema(self, rows: DataFrame | None = None) -> T.StructType:
        """The table's schema: what the first append had, kept beside the manifests."""
        path = f"{self.root}/schema"
        p = self.versions._path(path)
        if not p.getFileSystem(self.versions._conf).exists(p):
            if rows is None:
                raise ValueError("nothing was appended yet")
            nullable = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
            self.spark.createDataFrame([(nullable.json(),)], "schema string").coalesce(1).write.parquet(path)
        return T.StructType.fromJson(json.loads(self.spark.read.parquet(path).first()[0]))

    def tiers(self, version: int | None = None) -> DataFrame:
        """The live shards with their tier. Tier t holds sizes from target / fan^(1 - t) up; tier 0 and above are full size."""
        size = F.greatest(F.col("bytes"), F.lit(1)) / F.lit(self.target_bytes / 2)
        tier = F.least(F.lit(0), F.floor(F.log(size) / F.log(F.lit(float(self.fan)))))
        return self.manifest(version).withColumn("tier", tier.cast("long"))

    def compact(self) -> int:
        """Merge each tier that has at least ``fan`` shards, small tiers first; returns the version.

        A merge counts only if all its shards are still live when it is committed.
        """
        done = set()
        while True:
            version = self.versions.latest()
            tiers = self.tiers(version)
            full = tiers.filter("tier < 0").groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fan)
            todo = sorted(r.tier for r in full.collect() if r.tier not in done)
            if not todo:
                return version
            done.add(todo[0])
            self._merge(tiers.filter(F.col("tier") == todo[0]))

    def _merge(self, old: DataFrame) -> None:
        run = uuid.uuid4().hex[:12]
        folder = f"{self.root}/data/{run}"
        paths = [r.path for r in old.select("path").collect()]
        with self._packed():
            self.spark.read.schema(self._schema()).parquet(*paths).write.parquet(folder)
        gone = old.select("path")

        def change(live: DataFrame, new: int) -> DataFrame:
            if live.join(gone, "path", "left_semi").count() < len(paths):
                return live  # a rival has merged some of them; the copies made here are dead
            return live.join(gone, "path", "left_anti").unionByName(self._files(folder, run, new))

        self._commit(change)

    @contextmanager
    def _packed(self):
        """Read partitions of the target size, filled with whole small files."""
        want = {"maxPartitionBytes": self.target_bytes, "openCostInBytes": 0, "minPartitionNum": 1}
        keys = {f"spark.sql.files.{k}": v for k, v in want.items()}
        was = {k: self.spark.conf.get(k, None) for k in keys}
        try:
            for k, v in keys.items():
                self.spark.conf.set(k, str(v))
            yield
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version. Other versions' shards are not touched."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*paths)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete shards that none of the last versions lists; returns how many. No append or merge may run meanwhile."""
        last = self.versions.latest()
        live = self.manifest(last)
        for v in range(max(1, last - keep_versions + 1), last):
            live = live.unionByName(self.manifest(v))
        dead = self._files(f"{self.root}/data", "", 0).join(live.select("path").distinct(), "path", "left_anti")
        paths = [r.path for r in dead.select("path").collect()]
        for path in paths:
            p = self.versions._path(path)
            p.getFileSystem(self.versions._conf).delete(p, False)
        return len(paths)
