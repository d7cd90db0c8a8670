"""Names, renames and small texts in whatever file system Spark reaches."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


class Files:
    """The file system that holds a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def resolved(self, name: str) -> str:
        """The address behind a view of file systems, or the full address of a name."""
        return self.system.resolvePath(self.path(name)).toString()

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def make(self, name: str) -> None:
        self.system.mkdirs(self.path(name))

    def drop(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(folder))) if self.exists(folder) else []

    def move(self, name: str, to: str) -> None:
        """Rename; what has the new name already is replaced."""
        if self.exists(to):
            self.drop(to)
        if not self.system.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} cannot become {to}")

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A text that is there whole or not at all; an error if the name is taken."""
        stream = self.system.create(self.path(f"{name}.part"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.system.rename(self.path(f"{name}.part"), self.path(name)):
            raise FileExistsError(name)


def partition_value(folder: str) -> str:
    """The value in the name of a partition's folder."""
    return unquote(folder.split("=", 1)[1])


def arrow_uri(name: str) -> str:
    """An address as Arrow's file systems know it; a plain path is one of the local file system."""
    if name.startswith("/"):
        return f"file://{quote(name)}"
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!//)/*", "file:///", name))


def arrow_reaches(folder: str) -> bool:
    """Whether Arrow's file systems reach a folder that has just been made."""
    try:
        store, path = fs.FileSystem.from_uri(arrow_uri(folder))
        return store.get_file_info(path).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False
