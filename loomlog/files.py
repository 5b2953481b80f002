"""Small files of a Hadoop file system: reading, and publishing under a name that must not exist."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from .errors import ConflictError


class Files:
    """A folder, by paths relative to it. A ``file:`` folder must be one that every machine shares."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        top = self._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
        self.fs = top.getFileSystem(conf)
        self.root = self.fs.makeQualified(top).toString()

    def path(self, rel: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def names(self, rel: str) -> list[str]:
        """What stands in a folder; nothing if it is not there."""
        at = self.path(rel)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, rel: str) -> str:
        stream = self.fs.open(self.path(rel))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, rel: str) -> None:
        self.fs.delete(self.path(rel), True)

    def sync(self, rel: str) -> None:
        """Brings a written folder's files to disk before a name that depends on them is published (local file systems; others do so on close)."""
        if self.fs.getUri().getScheme() != "file":
            return
        at = self.path(rel).toUri().getPath()
        for name in [*os.listdir(at), ""]:
            fd = os.open(os.path.join(at, name), os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)

    def publish(self, rel: str, text: str) -> None:
        """Makes a file appear whole, or raises ConflictError if its name is taken."""
        if self.fs.getUri().getScheme() == "file":
            target = self.path(rel).toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            tmp = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, target)  # fails if it is there
            except FileExistsError as e:
                raise ConflictError(f"{rel} is taken") from e
            finally:
                os.unlink(tmp)
            return
        folder, _, name = rel.rpartition("/")
        tmp = self.path(f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        if not self.fs.rename(tmp, self.path(rel)):  # on HDFS a rename never replaces
            self.fs.delete(tmp, False)
            raise ConflictError(f"{rel} is taken")
