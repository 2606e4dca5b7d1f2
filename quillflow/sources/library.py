"""Reading and writing libraries: JSON documents with spare copies, texts, uploads, zipped backups."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow import schemas
from quillflow.functions.text import strip_bom

CORRUPT = "_corrupt"


def read_files(spark: SparkSession, root: str, glob: str = "*", binary: bool = False) -> DataFrame:
    """path (below root), bytes, modified and, as asked, content or text of all files below root that fit glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.regexp_replace("path", f"^.*?{_tail(root)}/", "")
    columns = [below.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    hidden = F.col("path").rlike(r"(^|/)(\.trash|\.staging|\.tmp-[^/]*)(/|$)")
    body = F.col("content") if binary else F.decode("content", "UTF-8").alias("text")
    return files.select(*columns, body).filter(~hidden)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """As read_files without the contents, which are then not read."""
    return read_files(spark, root, glob, binary=True).drop("content")


def _tail(root: str) -> str:
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return "".join(c if c.isalnum() or c in "_-" else f"\\{c}" for c in name)


def read_json(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """A row a document below root: path, status (ok, recovered from the .bak beside it, or corrupt) and doc (null if corrupt), of a fixed schema.

    Files of no bytes are not listed by Spark, and so count as missing.
    """
    parse = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    sound = lambda c: F.try_parse_json(c).isNotNull()
    main = read_files(spark, root, glob).select("path", "text")
    spare = read_files(spark, root, f"{glob}.bak").select(F.regexp_replace("path", r"\.bak$", "").alias("path"), F.col("text").alias("spare"))
    both = main.join(spare, "path", "full")
    status = F.when(sound(F.col("text")), "ok").when(sound(F.col("spare")), "recovered").otherwise("corrupt")
    doc = F.when(status == "ok", F.col("text")).when(status == "recovered", F.col("spare"))
    return both.select("path", status.alias("status"), parse(doc).alias("doc"))


def read_books(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all books below root/books, rebuilt from their own documents."""
    fields = schemas.BOOK.replace(" timestamp", " string").replace(" int", " string")  # coerced below, whatever they were written as
    docs = read_json(spark, f"{root}/books", "book.json", fields).filter("doc is not null")
    return schemas.normalize_book(docs.select("doc.*"))


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """book_id, index, content of all chapter files below root/books."""
    pattern = r"^([^/]+)/chapters/([0-9]+)\.txt$"
    rows = read_files(spark, f"{root}/books", "*.txt").filter(F.col("path").rlike(pattern))
    return rows.select(F.regexp_extract("path", pattern, 1).alias("book_id"), F.regexp_extract("path", pattern, 2).cast("int").alias("index"), strip_bom("text").alias("content"))


def read_progress_map(spark: SparkSession, root: str) -> DataFrame:
    """Positions from reading/progress.json, where they are a map by book."""
    docs = read_json(spark, f"{root}/reading", "progress.json", "progress map<string, struct<chapter_index: int, char_offset: int, chapter_ratio: double, percent: double, updated_at: string>>")
    rows = docs.filter("doc is not null").select(F.explode("doc.progress").alias("book_id", "p")).select("book_id", "p.*")
    return schemas.normalize_progress(rows)


class BadBackup(ValueError):
    """A zip file without the manifest of a backup."""


#: Bytes of an entry that a row can hold.
LARGEST_ENTRY = (1 << 31) - (1 << 20)


def _zip(path: str) -> tuple[zipfile.ZipFile, pa.NativeFile]:
    """A zip opened for seeking: its directory is read, its entries are not."""
    where, name = arrow_fs.FileSystem.from_uri(path)
    stream = where.open_input_file(name)
    if stream.size() < 22:  # what an empty zip has
        stream.close()
        raise zipfile.BadZipFile("too short for a zip")
    return zipfile.ZipFile(stream), stream


def backup_entries(spark: SparkSession, paths: str) -> DataFrame:
    """backup, entry, offset, bytes (inflated), path (below the backup's root), problem: the directory of each zip, read from its end. One that is no backup is a row with its problem."""
    names = ["backup", "entry", "offset", "bytes", "path", "problem"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def listed(source: str) -> list[tuple]:
        try:
            z, stream = _zip(source)
            with stream, z:
                inside = [i for i in z.infolist() if not i.is_dir()]
                manifest = next((i.filename for i in inside if i.filename.rsplit("/", 1)[-1] == "manifest.json"), None)
                if manifest is None:
                    raise BadBackup("no manifest.json")
                root = manifest[: -len("manifest.json")]
                return [(source, i.filename, i.header_offset, i.file_size, i.filename.removeprefix(root), "too large" if i.file_size > LARGEST_ENTRY else None) for i in inside]
        except (zipfile.BadZipFile, BadBackup) as why:
            return [(source, None, None, None, None, str(why))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                rows = listed(source)
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + 4096]), kinds)], names)

    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.mapInArrow(run, "backup string, entry string, offset long, bytes long, path string, problem string")


def read_backups(spark: SparkSession, paths: str, range_bytes: int = 1 << 26) -> DataFrame:
    """backup, path, content, problem: the files in each zip; a zip that is no backup is one row with its problem.

    Entries are dealt in ranges of their places, of some range_bytes each, so that many tasks read one zip, each from where its range begins; a task holds one entry. An entry whose bytes are damaged has
    its problem and no content.
    """
    names, kinds = ["backup", "path", "content", "problem"], [pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, z, stream = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                content, problem = None, row["problem"]
                if problem is None:
                    if row["backup"] != source:
                        if stream:
                            stream.close()
                        source = row["backup"]
                        z, stream = _zip(source)
                    try:
                        content = z.read(row["entry"])
                    except (zipfile.BadZipFile, zlib.error, EOFError) as why:
                        problem = str(why)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((row["backup"], row["path"], content, problem), kinds)], names)
        if stream:
            stream.close()

    entries = backup_entries(spark, paths)
    # by the entries' bytes, which are not in their rows
    total, n = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(n, -(-total // range_bytes)))
    entries = entries.repartitionByRange(ranges, "backup", "offset").sortWithinPartitions("backup", "offset")
    return entries.mapInArrow(run, "backup string, path string, content binary, problem string")


def write_version(df: DataFrame, root: str, name: str, keep_partitions: tuple[str, ...] = ()) -> str:
    """df as a new version of a table below root, committed whole; older versions stay as spare copies. Its path."""
    versions = f"{root.rstrip('/')}/{name}"
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(versions)
    fs = fs_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    taken = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    path = f"{versions}/v{max([int(v[1:]) for v in taken if v[1:].isdigit()], default=0) + 1:06d}"
    df.write.partitionBy(*keep_partitions).parquet(path) if keep_partitions else df.write.parquet(path)
    return path


def read_version(spark: SparkSession, root: str, name: str, back: int = 0) -> DataFrame:
    """The newest complete version of a table, or the one `back` versions before it."""
    versions = f"{root.rstrip('/')}/{name}"
    jvm = spark._jvm.org.apache.hadoop.fs
    fs_path = jvm.Path(versions)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = sorted(s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(jvm.Path(f"{s.getPath()}/_SUCCESS")))
    return spark.read.parquet(f"{versions}/{whole[-1 - back]}")
