"""Files and folders of a store on any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Paths are relative to the root's URI (file:, hdfs:, s3a:, ...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = (root if ":" in root else "file://" + root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.uri(path))

    def ls(self, path: str = "") -> list[str]:
        """Names in a folder; none if it is missing."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet, under another name first, so that readers see all of it or nothing; False if it exists."""
        at = self._path(path)
        if self._fs.exists(at):
            return False
        folder, _, name = path.rpartition("/")
        aside = self._path(f"{folder}/.{name}.part")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return self._fs.rename(aside, at)

    def rename(self, old: str, new: str) -> bool:
        parent = self._path(new).getParent()
        self._fs.mkdirs(parent)
        return self._fs.rename(self._path(old), self._path(new))

    def remove(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def copy_from(self, other: Files, path: str) -> None:
        """Copies a file or folder of another store to the same place here, whole or not at all."""
        aside = f"_incoming/{path.replace('/', '_')}"
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(other._fs, other._path(path), self._fs, self._path(aside), False, True, self._conf)
        if not self.exists(path):
            self.rename(aside, path)
        else:
            self.remove(aside)

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()
