"""A log of numbered entries in a folder, fenced: a number is taken by one writer alone."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def deleted(spark: SparkSession, path: str) -> None:
    found, system = located(spark, path)
    system.delete(found, True)


class Log:
    """Entries are files that are created without overwriting (one step on file systems such as HDFS); whoever comes second to a number is refused."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def newest(self, most: int) -> list[tuple[int, str]]:
        """The numbers and contents of the newest entries, the newest first."""
        path, system = located(self.spark, self.folder)
        if not system.exists(path):
            return []
        names = [f.getPath().getName() for f in system.listStatus(path)]
        numbers = sorted((int(n) for n in names if n.isdigit()), reverse=True)[:most]
        return [(n, content) for n in numbers if (content := self._content(n))]  # an entry without content is still being written

    def _content(self, number: int) -> str:
        path, system = located(self.spark, f"{self.folder}/{number}")
        source = system.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def append(self, number: int, content: str) -> None:
        path, system = located(self.spark, f"{self.folder}/{number}")
        try:
            entry = system.create(path, False)
        except Py4JJavaError as e:
            raise ValueError(f"version {number} was published by another writer") from e
        entry.write(content.encode())
        entry.close()

    def delete(self, number: int) -> None:
        deleted(self.spark, f"{self.folder}/{number}")
