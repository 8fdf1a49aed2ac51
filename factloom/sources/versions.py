"""A commit log in the shared folder: numbered entries, each made once and whole.

Tables are written under a version of their own, which no reader looks at; adding the log's next entry makes the version
current. So a writer that stops between any two writes changes nothing, and of two writers for one number one wins.
An entry is made by a rename that fails where the target exists (atomic on HDFS; on a local disk among the threads of one
process).
"""

from __future__ import annotations

import threading
from pyspark.sql import SparkSession

_local = threading.Lock()


class Conflict(Exception):
    """Another writer came first."""


class Log:
    """Entries under ``path``, numbered from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        """The entries there are, in order."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n) for n in names if n.isdigit())

    def text(self, number: int) -> str:
        stream = self.fs.open(self._path(f"{number:012d}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def entries(self) -> dict[int, str]:
        return {n: self.text(n) for n in self.numbers()}

    def add(self, text: str, number: int) -> bool:
        """Make entry ``number``; false if there is one already. It is filled under another name first, so that no reader
        finds it half written."""
        target, draft = self._path(f"{number:012d}"), self._path(f".{self.jvm.java.util.UUID.randomUUID()}.draft")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        with _local:
            # A rename fails where the target exists, but a local disk's replaces it.
            won = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not won:
            self.fs.delete(draft, False)
        return won

    def append(self, text: str, after: int | None = None) -> int:
        """Make the next entry, or the one after ``after`` and no other, and return its number."""
        if after is not None:
            if not self.add(text, after + 1):
                raise Conflict(f"entry {after + 1} of {self.path} is another writer's")
            return after + 1
        number = (self.numbers() or [-1])[-1] + 1
        while not self.add(text, number):
            number += 1
        return number

    def remove(self, number: int) -> None:
        self.fs.delete(self._path(f"{number:012d}"), False)

    def folders(self, path: str, prefix: str) -> dict[str, int]:
        """Names after ``prefix`` of the folders under a path, with their time of change in milliseconds."""
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        if not self.fs.exists(root):
            return {}
        return {s.getPath().getName()[len(prefix) :]: s.getModificationTime() for s in self.fs.listStatus(root) if s.getPath().getName().startswith(prefix)}

    def drop(self, path: str) -> None:
        """Remove a folder and what is in it."""
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)

