"""Atomic commits of versioned folders: a staged folder becomes version N + 1 by one rename.

That needs a store whose rename of a folder is atomic and fails if the target is
there, such as HDFS or a shared POSIX file system. Object stores copy instead:
there the root of the versions must be on a store that renames; the data that
they list may be anywhere.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import SparkSession


class Versions:
    """Numbered folders v0000000001, ... under a root. A commit fails if its number is taken, so that one of two rivals wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def staging(self) -> str:
        return f"{self.root}/_staging-{uuid.uuid4().hex[:12]}"

    def at(self, version: int) -> str:
        return f"{self.root}/v{version:010d}"

    def latest(self) -> int:
        """The last committed version; 0 if there is none."""
        root = self._path(self.root)
        fs = root.getFileSystem(self._conf)
        if not fs.exists(root):
            return 0
        names = (x.getPath().getName() for x in fs.listStatus(root))
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)

    def commit(self, staged: str, version: int) -> None:
        """Rename the staged folder to a version that must not exist yet."""
        target = self._path(self.at(version))
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        files.rename(self._path(staged), target, none)

    def update(self, write: Callable[[int, str], object]) -> int:
        """Commit what ``write(last version, staging path)`` makes, anew after each version that a rival has got in first."""
        while True:
            last, staged = self.latest(), self.staging()
            write(last, staged)
            try:
                self.commit(staged, last + 1)
                return last + 1
            except Exception:
                root = self._path(staged)
                root.getFileSystem(self._conf).delete(root, True)
                if self.latest() == last:  # not a rival's doing
                    raise
