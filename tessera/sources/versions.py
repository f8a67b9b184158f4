"""Versions of a table: a sandbox to write to, numbered versions, and a pointer to the active one.

Everything is a folder of Parquet files under ``base``; the pointer is a small file that is replaced
as a whole. A version is never written to again, so readers of an older one are not disturbed.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(posixpath.join(self.base, name))
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return posixpath.join(self.base, name)

    def write_sandbox(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at("sandbox"))

    def sandbox(self) -> DataFrame:
        return self.spark.read.parquet(self._at("sandbox"))

    def versions(self) -> list[str]:
        """Names of the versions, oldest first."""
        if not self._fs.exists(self._path("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if n.startswith("v") and n[1:].isdigit())

    def active_version(self) -> str | None:
        if not self._fs.exists(self._path("active.txt")):
            return None
        return self.spark.read.text(self._at("active.txt")).first()[0]

    def active(self) -> DataFrame:
        version = self.active_version()
        if version is None:
            raise FileNotFoundError(f"no version of {self.base} has been promoted")
        return self.spark.read.parquet(self._at(version))

    def promote(self) -> str:
        """The sandbox becomes the next version, and that the active one."""
        if not self._fs.exists(self._path("sandbox")):
            raise FileNotFoundError("no sandbox to promote")
        name = f"v{max([int(v[1:]) for v in self.versions()], default=0) + 1:03d}"
        self._fs.rename(self._path("sandbox"), self._path(name))
        self.rollback(name)
        return name

    def rollback(self, version: str) -> None:
        """Make ``version`` the active one."""
        if version not in self.versions():
            raise FileNotFoundError(f"version {version} does not exist")
        new = self._fs.create(self._path("active.new"), True)
        new.write(bytearray(version.encode()))
        new.close()
        self._fs.delete(self._path("active.txt"), False)
        self._fs.rename(self._path("active.new"), self._path("active.txt"))

    def discard(self) -> None:
        """Delete the sandbox."""
        self._fs.delete(self._path("sandbox"), True)
