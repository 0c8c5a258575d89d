"""Names and marks in any store that Spark reads, by its file system interface on the driver; contents go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def make(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.mkdirs(path)

    def names(self, name: str = "") -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) and fs.getFileStatus(path).isDirectory() else []

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)
