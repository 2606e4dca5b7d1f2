"""Where a library's files lie: an interface of relative paths, and the one over any file system that Spark reaches.

Tables are read and written by Spark (`sources.library`); a store is for what is handled file by file: documents, spare copies, the trash.
"""

from __future__ import annotations

import json
import posixpath
import secrets
import time
from typing import Any, Protocol

from pyspark.sql import SparkSession

TRASH, SPARE, UNFINISHED = ".trash", ".bak", ".tmp-"


class Storage(Protocol):
    """Paths are relative to the library's root, with "/" between their parts; there are no absolute ones."""

    def read(self, path: str) -> bytes | None: ...

    def write(self, path: str, data: bytes) -> None: ...

    def exists(self, path: str) -> bool: ...

    def remove(self, path: str) -> bool: ...

    def files(self, path: str = "") -> list[tuple[str, int]]: ...

    def move(self, path: str, to: str) -> None: ...


class BadPath(ValueError):
    """A path that leaves the root."""


def relative(path: str) -> str:
    clean = posixpath.normpath(path.replace("\\", "/")) if path else ""
    if clean.startswith(("/", "..")):
        raise BadPath(path)
    return "" if clean == "." else clean


class FileStorage:
    """A store in a folder of a file system that Hadoop knows: local, HDFS, or an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative(path)}".rstrip("/"))

    def read(self, path: str) -> bytes | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Beside the old file first, which is kept as a spare copy; a write that breaks off leaves it as it was."""
        unfinished = f"{path}{UNFINISHED}{secrets.token_hex(4)}"
        stream = self._fs.create(self._path(unfinished))
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self.exists(path):
            self.move(path, path + SPARE)
        self.move(unfinished, path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> bool:
        """A file, or a folder with all in it; whether there was one."""
        if not relative(path):
            raise BadPath(path)
        return self._fs.delete(self._path(path), True)

    def files(self, path: str = "") -> list[tuple[str, int]]:
        """Path and bytes of every file below a folder."""
        if not self.exists(path):
            return []
        found, out, start = self._fs.listFiles(self._path(path), True), [], len(self._fs.makeQualified(self._path("")).toString()) + 1
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString()[start:], status.getLen()))
        return sorted(out)

    def move(self, path: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        self._fs.delete(self._path(to), True)
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} could not be moved to {to}")


def read_json(store: Storage, path: str, fallback: Any = None) -> Any:
    """A document, or its spare copy where it is broken, or else the fallback."""
    for name in (path, path + SPARE):
        data = store.read(name)
        try:
            if data is not None:
                return json.loads(data.decode("utf-8-sig"))
        except ValueError:
            continue
    return fallback


def write_json(store: Storage, path: str, value: Any) -> None:
    store.write(path, json.dumps(value, ensure_ascii=False, indent=2).encode())


def to_trash(store: Storage, path: str, now: float | None = None) -> str:
    """Out of the way, not gone: its place in the trash."""
    place = f"{TRASH}/{timestamp_name(now)}-{new_id('t')}-{posixpath.basename(path)}"
    store.move(path, place)
    return place


def size(store: Storage, path: str = "") -> int:
    return sum(n for _, n in store.files(path))


def timestamp_name(now: float | None = None) -> str:
    """A local time as part of a file's name."""
    return time.strftime("%Y%m%d-%H%M%S", time.localtime(now))


def new_id(prefix: str = "id") -> str:
    return f"{prefix}_{secrets.token_hex(6)}"
