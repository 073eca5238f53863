"""Small files of a dataset through Hadoop's file system, so that any store that Spark reads will do."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name that driver and executors share; gone when the driver ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        path = join(shared, f"{name}-{uuid.uuid4().hex}")
        atexit.register(_removed, spark, path)
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix=f"pitwall-{name}-")
    atexit.register(shutil.rmtree, path, True)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    try:
        Files(spark).remove(path)
    except Exception:  # the session may have ended before the interpreter does
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


class Files:
    """Whole small files and folders by path; only the driver uses it."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._conf), found

    def exists(self, path: str) -> bool:
        store, at = self._at(path)
        return store.exists(at)

    def absolute(self, path: str) -> str:
        """The full name of a path, with its store."""
        store, at = self._at(path)
        return store.makeQualified(at).toString()

    def read(self, path: str) -> bytes:
        store, at = self._at(path)
        if not store.exists(at):
            raise FileNotFoundError(path)
        stream = store.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, content: bytes | str) -> None:
        store, at = self._at(path)
        stream = store.create(at, True)
        try:
            stream.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            stream.close()

    def load(self, path: str):
        return json.loads(self.read(path))

    def dump(self, path: str, value) -> None:
        """JSON; a number that JSON has no word for is an error."""
        self.write(path, json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False, default=str))

    def remove(self, path: str) -> None:
        store, at = self._at(path)
        store.delete(at, True)

    def move(self, path: str, to: str) -> None:
        store, at = self._at(path)
        target = self._jvm.org.apache.hadoop.fs.Path(to)
        if target.getParent() is not None:
            store.mkdirs(target.getParent())
        if not store.rename(at, target):
            raise OSError(f"{path} cannot be moved to {to}")

    def children(self, path: str) -> list[str]:
        store, at = self._at(path)
        return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []

    def beside(self, path: str) -> str:
        """A fresh path next to ``path``, for building what shall replace it."""
        return f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}"

    def swap(self, built: str, path: str) -> None:
        """Put ``built`` in the place of ``path``; what was there goes last."""
        old = self.beside(path)
        had = self.exists(path)
        if had:
            self.move(path, old)
        self.move(built, path)
        if had:
            self.remove(old)
