"""Files in whatever store Spark reads, by Hadoop's file systems: the few operations that tables with versions and leases need."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._fs_package.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str) -> list[tuple[str, float]]:
        """(name, seconds since 1970 of the last change) of what lies in a folder; nothing if there is none."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a small file."""
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a small file that appears whole or not at all; false if the name is taken. The way of Spark's own checkpoints: a rename that does not replace."""
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}"
        self.write(draft, text)
        kind = getattr(self._fs_package, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        source, target = self._path(draft), self._path(name)
        try:
            self._fs_package.FileContext.getFileContext(self._path(self.root).toUri(), self._conf).rename(source, target, how)
        except Py4JJavaError as e:
            self._fs.delete(source, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)
