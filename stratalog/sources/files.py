"""Small files on whatever file system a path names, through Hadoop's own clients."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside, then rename: the name appears whole, and never replaces another file."""
        beside = f"{name}.new"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self._fs.rename(self._path(beside), self._path(name)):
            raise OSError(f"{name} is there already, or can't be written")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
