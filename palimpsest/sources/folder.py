"""Small files of a store on any Hadoop file system: local disk, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URI; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self._path(self.path(name))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str | None:
        """The text of a file, None if there is none."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> bool:
        """Write a file and flush it to the disks; with ``new`` only if it does not exist: False if it does."""
        try:
            stream = self.fs.create(self._at(name), not new)
        except Exception:
            if new and self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        return True

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name)))

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path(old)} cannot be renamed")
