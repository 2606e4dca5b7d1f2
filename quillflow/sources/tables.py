"""Tables that are changed in part, by several writers at once: rows in buckets by key, and a manifest for each version that names each bucket's files.

A change reads the buckets that its keys are in, writes them anew beside the old ones, and commits by creating the next version's manifest, which only one writer
can. The other finds out, and takes its change up again: if the versions that came between left its buckets alone it only names its files in the next
manifest, else it reads the new rows and computes its change again. So no writer loses another's rows, and readers see whole versions only.

A manifest has a line for each bucket, whatever the number of rows. Folders that no kept manifest names, of writers that failed or lost, go with `clean`.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillflow.operators import merge

BUCKETS, TRIES = 64, 20


class Conflict(RuntimeError):
    """Other writers committed before each try."""


@dataclass
class Manifest:
    """A version: bucket to folder (below the table's), the table's schema, when it was made, and the last batch of each stream that is in it."""

    version: int = 0
    buckets: dict[int, str] = field(default_factory=dict)
    schema: dict | None = None
    at: float = 0.0
    batches: dict[str, int] = field(default_factory=dict)


class Files:
    """The few things that a table does with files itself, on the driver: small ones, over any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm.org.apache.hadoop, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[tuple[str, float]]:
        """Names and times of change, in seconds, of what is in a folder."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Whether the file was made, whole; not if there is one already."""
        spare, target = self.path(f".new-{uuid.uuid4().hex}"), self.path(name)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(spare, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.local:
                # a link is made or not, as a rename on other file systems; there a local rename would overwrite
                os.link(urlsplit(spare.toString()).path, urlsplit(target.toString()).path)
            else:
                self.jvm.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(spare, target, self._no_overwriting())
            return True
        except FileExistsError:
            return False
        except Exception as why:
            if "FileAlreadyExists" in str(why):
                return False
            raise
        finally:
            self.fs.delete(spare, False)

    def _no_overwriting(self):
        options = SparkContext._gateway.new_array(self.jvm.fs.Options.Rename, 1)
        options[0] = self.jvm.fs.Options.Rename.NONE
        return options

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class BucketTable:
    """A table below root, in buckets by the hash of its key column."""

    def __init__(self, spark: SparkSession, root: str, key: str = "book_id", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.n = spark, root.rstrip("/"), key, buckets
        self.files = Files(spark, self.root)

    # Reading

    def version(self) -> int:
        return max((int(n[:-5]) for n, _ in self.files.names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or of the newest; version 0 is an empty table."""
        version = self.version() if version is None else version
        if not version:
            return Manifest()
        found = json.loads(self.files.read(f"manifests/{version:012d}.json"))
        return Manifest(version, {int(b): p for b, p in found["buckets"].items()}, found["schema"], found["at"], found.get("batches", {}))

    def bucket(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.n)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version; of some buckets only, other buckets' files are not opened."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        if manifest.schema is None:
            raise FileNotFoundError(f"there is no version of {self.root} yet")
        schema = StructType.fromJson(manifest.schema)
        paths = [f"{self.root}/{p}" for b, p in sorted(manifest.buckets.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Changing

    def change(self, touched: list[int], new: Callable[[DataFrame | None, int], DataFrame], tries: int = TRIES, batch: tuple[str, int] | None = None) -> int:
        """Commits new(rows of the touched buckets, or None before the first version; the version that will be) in their place. The new version.

        batch: a stream's name and the number of its batch that the change is; one that the table has already changes nothing, so that a batch that is sent again counts once.
        """
        base, folder, schema = None, "", None
        for _ in range(tries):
            now = self.manifest()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now.version
            if base is None or any(now.buckets.get(b) != base.buckets.get(b) for b in touched) or now.version and base.schema is None:
                base, folder = now, f"data/{uuid.uuid4().hex}"
                rows = new(self._rows(now, touched) if now.schema else None, now.version + 1)
                schema = rows.schema.jsonValue()
                rows.withColumn("_bucket", self.bucket()).repartition(max(1, min(self.n, len(touched))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            made = {int(n.split("=")[1]) for n, _ in self.files.names(folder) if n.startswith("_bucket=")}
            buckets = {b: p for b, p in now.buckets.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in sorted(made)}
            if not made <= set(touched):
                raise ValueError("a change made rows of buckets that it did not touch")
            text = json.dumps({"buckets": buckets, "schema": schema, "at": time.time(), "batches": now.batches | (dict([batch]) if batch else {})})
            if self.files.create_once(f"manifests/{now.version + 1:012d}.json", text):
                return now.version + 1
        raise Conflict(f"{tries} tries were too late")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of keys' rows: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def upsert(self, rows: DataFrame) -> int:
        """Rows in place of those of the same keys."""
        return self.change(self.buckets_of(rows), lambda old, _: rows if old is None else old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows.select(*old.columns)))

    def patch(self, changes: DataFrame) -> int:
        """The values of changes (the key, one row each, and some columns) where they are not null; keys that are not there are left alone."""
        return self.change(self.buckets_of(changes), lambda old, _: merge.patch(old, changes, self.key))

    def remove(self, keys: DataFrame) -> int:
        return self.change(self.buckets_of(keys), lambda old, _: old.join(keys.select(self.key).distinct(), self.key, "left_anti"))

    def clean(self, keep: int = 2, older_s: float = 86_400.0) -> list[str]:
        """Removes all manifests but the newest `keep`, and the folders that these do not name and that are older than older_s, which gives writers under way that time. Their names."""
        versions = sorted(int(n[:-5]) for n, _ in self.files.names("manifests") if n.endswith(".json"))
        kept = {p.split("/")[1] for v in versions[-keep:] for p in self.manifest(v).buckets.values()}
        gone = [n for n, at in self.files.names("data") if n not in kept and time.time() - at >= older_s]
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v:012d}.json")
        for name in gone:
            self.files.delete(f"data/{name}")
        return gone
