"""Tables kept as immutable folders that a reader puts together: ranges of batches, and versions of courses.

A folder counts once its writer has finished it (`_SUCCESS`), so readers never see half of one. Paths are any that the
cluster's file systems open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """The finished folders below a root, by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")


class Tiles(Folder):
    """Folders `first-last` of batches: the widest ones from 0 on make up the table as of a batch."""

    def ranges(self) -> list[tuple[int, int]]:
        return sorted((int(a), int(b)) for a, _, b in (n.partition("-") for n in self.names()))

    def cover(self, upto: int | None = None) -> list[tuple[int, int]]:
        """Adjoining ranges from 0 on, none beyond `upto`, each the widest that starts where the one before it ends."""
        known, out, at = self.ranges(), [], 0
        while fit := [b for a, b in known if a == at and (upto is None or b <= upto)]:
            out.append((at, max(fit)))
            at = out[-1][1] + 1
        return out

    def read(self, schema: str, upto: int | None = None) -> DataFrame:
        """The rows of the covering folders with `tile`, the last batch of the folder."""
        out = self.spark.createDataFrame([], f"{schema}, tile long")
        for a, b in self.cover(upto):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{a}-{b}").selectExpr("*", f"{b}L as tile"))
        return out

    def forget(self, before: int) -> None:
        """Drops the folders that end before a batch and lie inside a wider one."""
        known = self.ranges()
        for a, b in known:
            if b < before and any(c <= a and b <= d and (c, d) != (a, b) for c, d in known):
                self.drop(f"{a}-{b}")
