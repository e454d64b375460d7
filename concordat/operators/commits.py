"""Documents that are put under their name or not at all: what an optimistic writer needs of a file system.

A document is written aside and given its name in one step that fails if the name is taken, so readers see whole
documents only, and of several writers of one name exactly one succeeds. On a local disk that step is a hard link, on
HDFS a rename without overwriting, both atomic. The file system must offer one of them; object stores without a conditional
put don't.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        root = self._at("")
        self._fs = root.getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"
        for name in ("", "aside"):
            self._fs.mkdirs(self._at(name))

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def put(self, name: str, document: bytes) -> bool:
        """Whether ``document`` now stands under ``name``; false if another one did before."""
        aside, target = self._at(f"aside/{uuid.uuid4().hex}"), self._at(name)
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(document))
        out.close()
        try:
            return self._linked(aside, target) if self._local else self._renamed(aside, target)
        finally:
            self._fs.delete(aside, False)

    def _linked(self, aside, target) -> bool:  # noqa: ANN001
        with contextlib.suppress(FileExistsError):
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        return False

    def _renamed(self, aside, target) -> bool:  # noqa: ANN001
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        array = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        array[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(target), array)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def claim(self, name: str) -> int:
        """The next whole number from 1 that nobody has claimed under ``name``: found by doubling and halving, then put."""
        taken = lambda n: self.exists(f"{name}/{n}")
        low, high = 0, 1
        while taken(high):
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if taken(mid) else (low, mid)
        while not self.put(f"{name}/{high}", b""):
            high += 1
        return high
