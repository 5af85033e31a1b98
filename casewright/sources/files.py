"""Hadoop file system calls for pointers, versions and partition folders.

They work on whatever storage the paths name, never on the driver's local disk alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder on any storage Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def children(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._at("")))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, name: str, new: str) -> None:
        if not self._fs.rename(self._at(name), self._at(new)):
            raise OSError(f"{name} in {self.path} could not be renamed to {new}")

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Replace a small file: written aside, then renamed over the old one in one step, so it is never absent."""
        aside = f"{name}.tmp"
        stream = self._fs.create(self._at(aside), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        overwrite = self._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        place = self._fs.makeQualified(self._at(name))
        fs.FileContext.getFileContext(place.toUri(), self._conf).rename(self._fs.makeQualified(self._at(aside)), place, overwrite)
