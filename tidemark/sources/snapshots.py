"""Versioned snapshots of a table: a new version is written whole and made current by one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the current version, 0 if there is none. Pointer files are never overwritten, so the highest is current."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[8:]) for n in names if n.startswith("CURRENT.")), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        n = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.root}/v{n}") if n else None

    def publish(self, table: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Write the next version and make it current; a failure on the way leaves the current one in force."""
        n = self.version() + 1
        w = table.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/v{n}")
        tmp = self._path(f"{self.root}/_pointer.{n}")
        self._fs.create(tmp, True).close()
        if not self._fs.rename(tmp, self._path(f"{self.root}/CURRENT.{n}")):
            raise RuntimeError("another writer published this version")
        return n
