"""What a library takes on disk, the health of its files, what a backup holds, and what may be cleared away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions.text import format_bytes
from quillflow.sources.store import Storage

SECTIONS = ["books", "reading", "index", "backups", ".trash", ".staging"]
NOT_IN_BACKUP, TEMPORARY, BACKUP_SUFFIX = (".trash/", ".staging/", "index/"), ".tmp-", ".bak"
STAGING_TTL_S, ROBOTS_TTL_S = 2 * 3600, 600


def section(path: Column) -> Column:
    top = F.element_at(F.split(path, "/"), 1)
    return F.when(top.isin(SECTIONS), top).otherwise("other")


def usage(files: DataFrame) -> DataFrame:
    """section, owner (a book's id; null for a section's total and for all), n_files, bytes: one grouping pass over files (path, bytes)."""
    owner = F.when(section(F.col("path")) == "books", F.element_at(F.split("path", "/"), 2))
    rows = files.select(section(F.col("path")).alias("section"), owner.alias("owner"), "bytes")
    sets = rows.groupingSets([["section", "owner"], ["section"], []], "section", "owner").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("g"))
    return sets.filter("g <> 0 or owner is not null").select("section", "owner", "n_files", "bytes", format_bytes(F.col("bytes")).alias("shown"))


def largest_books(files: DataFrame, n: int = 50) -> DataFrame:
    rows = files.filter(section(F.col("path")) == "books").groupBy(F.element_at(F.split("path", "/"), 2).alias("book_id")).agg(F.sum("bytes").alias("bytes"))
    return rows.orderBy(F.col("bytes").desc(), "book_id").limit(n)


def json_health(files: DataFrame) -> DataFrame:
    """file and status of JSON files (path, text): ok, recovered (its .bak is sound) or corrupt; each pair once."""
    sound = F.try_parse_json("text").isNotNull()
    main = files.filter(F.endswith("path", F.lit(".json"))).select("path", sound.alias("ok"))
    spare = files.filter(F.endswith("path", F.lit(".json.bak"))).select(F.regexp_replace("path", r"\.bak$", "").alias("path"), sound.alias("spare"))
    status = F.when(F.col("ok"), "ok").when(F.col("spare"), "recovered").otherwise("corrupt")
    return main.join(spare, "path", "left").select(F.col("path").alias("file"), status.alias("status")).dropDuplicates(["file", "status"])


def in_backup(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    outside = F.lit(False)
    for prefix in NOT_IN_BACKUP:
        outside = outside | F.startswith(path, F.lit(prefix))
    return ~outside & ~F.startswith(name, F.lit(TEMPORARY)) & ~F.endswith(path, F.lit(BACKUP_SUFFIX))


def backup_manifest(files: DataFrame) -> DataFrame:
    """One row: format, version, n_files and bytes of what a backup of files (path, bytes) holds."""
    kept = files.filter(in_backup(F.col("path")))
    return kept.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(F.lit("library-backup").alias("format"), F.lit(1).alias("version"), "n_files", "bytes")


def expired(rows: DataFrame, at: str, now: Column, ttl_s: int = STAGING_TTL_S) -> DataFrame:
    """Rows older than ttl_s, or of unknown age."""
    return rows.filter(F.col(at).isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp")) > ttl_s))


def _targets(names: list[str]) -> dict[str, Column]:
    """Which files each of the named targets is made of."""
    pattern = {"snapshots": r"/toc-snapshot\.json$", "rebuild-index": "^index/", "trash": r"^\.trash/", "staging": r"^\.staging/"}
    unknown = [t for t in names if t not in pattern]
    if unknown:
        raise ValueError(f"no target {unknown[0]!r}; there are {', '.join(pattern)}")
    return {t: F.col("path").rlike(pattern[t]) for t in names}


def cleanup(files: DataFrame, targets: list[str]) -> DataFrame:
    """target, n_files and bytes that clearing snapshots, rebuild-index, trash or staging would free."""
    named = F.array_compact(F.array(*[F.when(p, F.lit(t)) for t, p in _targets(targets).items()]))
    return files.select("bytes", F.explode(named).alias("target")).groupBy("target").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


def listed(books: DataFrame, by: str = "bytes") -> DataFrame:
    """Books (title, bytes, total_chapters) by size, by number of chapters, or by title as people sort it."""
    orders = {"bytes": F.col("bytes").desc(), "chapters": F.col("total_chapters").desc(), "title": F.collate("title", "UNICODE").asc()}
    if by not in orders:
        raise ValueError(f"by must be one of {', '.join(orders)}")
    return books.orderBy(orders[by], "book_id")


def clear(store: Storage, files: DataFrame, targets: list[str]) -> list[tuple[str, int, int]]:
    """Remove what the targets are made of from the store that files (path, bytes) lists; what `cleanup` told of each. Paths come in parts, not all at once."""
    freed = [(r.target, r.n_files, r.bytes) for r in cleanup(files, targets).collect()]  # a row a target
    for fits in _targets(targets).values():
        for row in files.filter(fits).select("path").toLocalIterator():
            store.remove(row.path)
    return freed
