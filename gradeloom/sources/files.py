"""Small files and folders in whatever file system a path names, by Spark's own access to it."""

import re
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Folder:
    """Marker files below one folder: what a commit needs, none of it in proportion to the data."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        try:
            return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))
        except Py4JJavaError as error:
            if "FileNotFoundException" in error.java_exception.getClass().getName():
                return []
            raise

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does. It is seen with its text only once that is complete."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as error:
            if self._fs.exists(self._at(name)):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        """The text of a small file; empty if it does not exist or is being written."""
        if not self._fs.exists(self._at(name)):
            return ""
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def modified(self, name: str) -> float:
        """Seconds since the epoch at which a file or folder was last changed."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def copy_head(self, name: str, to: str, share: float) -> None:
        """Copy the first share of a file's bytes, as a writer that stopped leaves them."""
        size = int(self._fs.getFileStatus(self._at(name)).getLen() * share)
        out = self._fs.create(self._at(to), False)
        source = self._fs.open(self._at(name))
        self._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
        source.close()
        out.close()


def plain(file: str) -> str:
    """A file's name in one form: Spark's readers differ in how they write local ones and escape others."""
    return re.sub("^file:/+", "file:///", unquote(file))


def failed_file(error: Exception) -> str | None:
    """The file that a failed job could not read, if that is why it failed."""
    if isinstance(error, PySparkException):
        known = (error.getCondition() or "").startswith("FAILED_READ_FILE")
        return (error.getMessageParameters() or {}).get("path") if known else None
    cause = error.java_exception if isinstance(error, Py4JJavaError) else None
    while cause is not None:
        if cause.getClass().getName() == "org.apache.spark.SparkException" and (cause.getCondition() or "").startswith("FAILED_READ_FILE"):
            return cause.getMessageParameters().get("path")
        cause = cause.getCause()
    return None
