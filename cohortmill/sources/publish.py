"""Published tables: a new version is built beside the old one, and one atomic step makes it the one that readers see.

A table is a folder: a folder of Parquet for each version, and `_published` with an empty file for each that was
published, named after its number and its folder. Creating that file is the step: it exists or it doesn't, on every file
system that Spark writes to, and readers take the file with the largest number. A build that fails, or whose tests find
rows, leaves no such file, and its folder is removed. The last `keep` versions stay for readers that began before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: A data test: returns the failing rows.
Test = Callable[[DataFrame], DataFrame]


class Published:
    """The published tables under one folder, which executors and driver share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _markers(self, name: str) -> list[tuple[int, str]]:
        fs, at = self._fs(f"{self.root}/{name}/_published")
        if not fs.exists(at):
            return []
        found = (str(x.getPath().getName()).partition("-") for x in fs.listStatus(at))
        return sorted((int(n), folder) for n, _, folder in found if n.isdigit())

    def versions(self, name: str) -> list[int]:
        return [n for n, _ in self._markers(name)]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as it was last published, or one of its versions that are kept."""
        found = [(n, folder) for n, folder in self._markers(name) if version in (None, n)]
        if not found:
            raise ValueError(f"{name!r} was not published" + (f" as version {version}" if version else ""))
        return self.spark.read.parquet(f"{self.root}/{name}/{found[-1][1]}")

    def publish(self, name: str, df: DataFrame, tests: Sequence[Test] = (), keep: int = 2) -> DataFrame:
        """Write df as the next version, run the tests over what was written, then let readers see it."""
        if not name.replace("_", "").isalnum():
            raise ValueError(f"{name!r} is no name of a table")
        folder = uuid.uuid4().hex
        path = f"{self.root}/{name}/{folder}"
        try:
            df.write.parquet(path)
            built = self.spark.read.parquet(path)
            for test in tests:
                if test(built).limit(1).count():
                    raise ValueError(f"a test of {name!r} found rows; the old version stays")
        except BaseException:
            fs, at = self._fs(path)
            fs.delete(at, True)
            raise
        number = max(self.versions(name), default=0) + 1
        fs, at = self._fs(f"{self.root}/{name}/_published/{number:010d}-{folder}")
        if not fs.createNewFile(at):
            raise RuntimeError(f"{at} exists")
        for n, old in self._markers(name)[:-keep]:
            # Readers stop finding a version before its rows go.
            for gone in (f"{self.root}/{name}/_published/{n:010d}-{old}", f"{self.root}/{name}/{old}"):
                fs, at = self._fs(gone)
                fs.delete(at, True)
        return built

    def drop(self, name: str) -> None:
        """Readers stop finding the table, then its rows go."""
        for gone in (f"{self.root}/{name}/_published", f"{self.root}/{name}"):
            fs, at = self._fs(gone)
            fs.delete(at, True)
