"""Tables and folders of a run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": f"{4 << 20}b"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the application's, in the shared one."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost no recomputation."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def leanly(spark: SparkSession) -> Iterator[None]:
    """Jobs within leave no shuffle files behind (Spark 4.1 and later; else they stay until the driver collects its garbage), and rows go to Python in batches of 4 MB at most.
    For tables that are settled or collected there; what is only planned is not touched."""
    before = {name: spark.conf.get(name, None) for name in _LEAN}
    for name, value in _LEAN.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def made(spark: SparkSession) -> list[str]:
    """The folders that this application has been given and not removed."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Folders that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    left = _made.get(spark.sparkContext.applicationId, [])
    left[:] = [p for p in left if p not in set(paths)]
