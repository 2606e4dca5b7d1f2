"""Entities of the library: their columns, enumerations, migrations, normalisation and validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions import coerce as C
from quillflow.functions.text import char_count, content_hash, trim

# The words that stand in stored data.
READING, FOLLOWING, FINISHED, UNREAD = "在读", "追更中", "已读完", "未读"
BOOK_STATUS = [READING, FOLLOWING, FINISHED, UNREAD]
ALL_PILE = "全部"
FETCH_NONE, FETCHING, FETCH_PARTIAL, FETCH_DONE = "未抓", "抓取中", "部分失败", "完成"
FETCH_STATUS = [FETCH_NONE, FETCHING, FETCH_PARTIAL, FETCH_DONE]
CHAPTER_OK, CHAPTER_FAILED, CHAPTER_MISSING = "成功", "失败", "缺失"
SOURCE_KINDS = ["local", "import", "fetch", "userscript", "paste"]
CHECK_DAYS = {"daily": 1, "every3days": 3, "weekly": 7}
CHECK_MODES = ["manual", *CHECK_DAYS]
UNNAMED_CHAPTER = "未命名章节"
SCHEMA_VERSION = 1

VERSIONING = "updatedAt timestamp, schemaVersion int, syncState string, owner_id string"
BOOK = (
    "book_id string, title string, author string, cover string, source_site string, toc_url string, intro string, tags array<string>, created_at timestamp, last_read_at timestamp, "
    "first_fetched_at timestamp, last_checked_at timestamp, last_updated_at timestamp, source_kind string, total_chapters int, read_chapters int, new_chapters int, check_mode string, "
    f"next_check_at timestamp, status string, fetch_status string, {VERSIONING}"
)
CHAPTER = "book_id string, index int, title string, char_count int, is_ok boolean, fetched_at timestamp, content_hash string, origin string, content string"
PROGRESS = "book_id string, chapter_index int, char_offset int, chapter_ratio double, percent double, updated_at timestamp"
MARK = "id string, book_id string, chapter_index int, char_offset int, chapter_ratio double, selected_text string, content string, created_at timestamp"
HISTORY = "book_id string, chapter_index int, char_offset int, chapter_title string, at timestamp"
SESSION = "book_id string, started_at timestamp, ended_at timestamp, duration_ms bigint, day string"
SNAPSHOT = "book_id string, taken_at timestamp, index int, title string, content_hash string, char_count int"
NOTIFICATION = "id string, at timestamp, read boolean, type string, book_id string, book_title string, new_chapters int, total_chapters int, message string"
ENTITIES = {"book": BOOK, "chapter": CHAPTER, "progress": PROGRESS, "bookmark": MARK, "note": MARK, "history": HISTORY, "session": SESSION, "snapshot": SNAPSHOT, "notification": NOTIFICATION}


def _cols(df: DataFrame) -> Callable[[str], Column]:
    """A column by name, null where df has none of that name."""
    return lambda name: F.col(name) if name in df.columns else F.lit(None)


def versioning(df: DataFrame, fallback: Column) -> list[Column]:
    c = _cols(df)
    return [
        F.coalesce(C.as_time(c("updatedAt")), fallback).alias("updatedAt"),
        F.coalesce(C.as_int(c("schemaVersion"), None), F.lit(SCHEMA_VERSION)).alias("schemaVersion"),
        C.as_trimmed(c("syncState"), "local").alias("syncState"),
        C.as_trimmed(c("owner_id"), "local").alias("owner_id"),
    ]


def normalize_book(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows with any subset of a book's columns, of any types, to BOOK; what is missing or malformed gets its default."""
    c, now = _cols(df), F.current_timestamp() if now is None else now
    created = F.coalesce(C.as_time(c("created_at")), now)
    total = C.as_count(c("total_chapters"))
    empty_is_null = lambda name: F.nullif(C.as_trimmed(c(name)), F.lit(""))
    return df.select(
        C.as_trimmed(c("book_id")).alias("book_id"),
        C.as_trimmed(c("title")).alias("title"),
        C.as_trimmed(c("author")).alias("author"),
        empty_is_null("cover").alias("cover"),
        F.coalesce(empty_is_null("source_site"), F.lit("local")).alias("source_site"),
        empty_is_null("toc_url").alias("toc_url"),
        C.as_string(c("intro")).alias("intro"),
        C.as_strings(c("tags")).alias("tags"),
        created.alias("created_at"),
        *[C.as_time(c(n)).alias(n) for n in ("last_read_at", "first_fetched_at", "last_checked_at", "last_updated_at")],
        C.as_enum(C.as_trimmed(c("source_kind")), SOURCE_KINDS, "local").alias("source_kind"),
        total.alias("total_chapters"),
        F.least(C.as_count(c("read_chapters")), total).alias("read_chapters"),
        C.as_count(c("new_chapters")).alias("new_chapters"),
        C.as_enum(C.as_trimmed(c("check_mode")), CHECK_MODES, "manual").alias("check_mode"),
        C.as_time(c("next_check_at")).alias("next_check_at"),
        C.as_enum(c("status"), BOOK_STATUS, UNREAD).alias("status"),
        C.as_enum(c("fetch_status"), FETCH_STATUS, FETCH_NONE).alias("fetch_status"),
        *versioning(df, created),
    )


def book_problems() -> Column:
    """The names of the rules that a book's row breaks."""
    checks = {
        "book_id missing": F.coalesce(F.col("book_id"), F.lit("")) == "",
        "book_id malformed": (F.coalesce(F.col("book_id"), F.lit("")) != "") & ~F.col("book_id").rlike("^[0-9a-zA-Z_-]+$"),
        "title missing": F.coalesce(F.col("title"), F.lit("")) == "",
        "status unknown": ~F.coalesce(F.col("status").isin(BOOK_STATUS), F.lit(False)),
        "fetch_status unknown": ~F.coalesce(F.col("fetch_status").isin(FETCH_STATUS), F.lit(False)),
        "total_chapters negative": ~F.coalesce(F.col("total_chapters") >= 0, F.lit(False)),
        "read_chapters over total": F.coalesce(F.col("read_chapters") > F.col("total_chapters"), F.lit(False)),
        "schemaVersion other": ~F.coalesce(F.col("schemaVersion") == SCHEMA_VERSION, F.lit(False)),
        "syncState other": ~F.coalesce(F.col("syncState") == "local", F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))


def normalize_chapter(df: DataFrame) -> DataFrame:
    """Rows with any subset of a chapter's columns to CHAPTER; counts and hashes come from the content where it is there."""
    c = _cols(df)
    index = C.as_count(c("index"))
    default = F.when(index > 0, F.concat(F.lit("第 "), index.cast("string"), F.lit(" 章"))).otherwise(F.lit(UNNAMED_CHAPTER))
    title = F.coalesce(F.nullif(C.as_trimmed(c("title")), F.lit("")), default)
    content = c("content").cast("string")
    return df.select(
        C.as_trimmed(c("book_id")).alias("book_id"), index.alias("index"), title.alias("title"),
        F.coalesce(char_count(content), C.as_count(c("char_count"))).alias("char_count"), C.as_bool(c("is_ok")).alias("is_ok"), C.as_time(c("fetched_at")).alias("fetched_at"),
        F.coalesce(content_hash(content), C.as_trimmed(c("content_hash"))).alias("content_hash"), C.as_trimmed(c("origin"), "manual").alias("origin"), content.alias("content"),
    )


def chapter_state(is_ok: str = "is_ok", fetched_at: str = "fetched_at") -> Column:
    return F.when(F.col(is_ok), CHAPTER_OK).when(F.col(fetched_at).isNotNull(), CHAPTER_FAILED).otherwise(CHAPTER_MISSING)


def normalize_progress(df: DataFrame) -> DataFrame:
    c = _cols(df)
    return df.select(
        C.as_trimmed(c("book_id")).alias("book_id"), F.greatest(C.as_int(c("chapter_index"), 1), F.lit(1)).alias("chapter_index"), C.as_count(c("char_offset")).alias("char_offset"),
        C.as_ratio(c("chapter_ratio")).alias("chapter_ratio"), C.as_ratio(c("percent")).alias("percent"), F.coalesce(C.as_time(c("updated_at")), F.current_timestamp()).alias("updated_at"),
    )


def normalize_mark(df: DataFrame) -> DataFrame:
    c = _cols(df)
    return df.select(
        C.as_trimmed(c("id")).alias("id"), C.as_trimmed(c("book_id")).alias("book_id"), F.greatest(C.as_int(c("chapter_index"), 1), F.lit(1)).alias("chapter_index"), C.as_count(c("char_offset")).alias("char_offset"),
        C.as_ratio(c("chapter_ratio")).alias("chapter_ratio"), C.as_string(c("selected_text")).alias("selected_text"), C.as_string(c("content")).alias("content"), F.coalesce(C.as_time(c("created_at")), F.current_timestamp()).alias("created_at"),
    )


def normalize_session(df: DataFrame) -> DataFrame:
    c = _cols(df)
    started = C.as_time(c("started_at"))
    return df.select(
        C.as_trimmed(c("book_id")).alias("book_id"), started.alias("started_at"), C.as_time(c("ended_at")).alias("ended_at"), F.greatest(C.as_long(c("duration_ms"), 0), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.nullif(trim(c("day").cast("string")), F.lit("")), F.date_format(started, "yyyy-MM-dd")).alias("day"),
    )


def normalize_history(df: DataFrame) -> DataFrame:
    c = _cols(df)
    return df.select(
        C.as_trimmed(c("book_id")).alias("book_id"), F.greatest(C.as_int(c("chapter_index"), 1), F.lit(1)).alias("chapter_index"), C.as_count(c("char_offset")).alias("char_offset"),
        C.as_string(c("chapter_title")).alias("chapter_title"), F.coalesce(C.as_time(c("at")), F.current_timestamp()).alias("at"),
    )


class MigrationError(ValueError):
    """Data of a newer version than this library, or of one from which no step leads on."""


def migrate(df: DataFrame, version: int, steps: Sequence[tuple[int, int, Callable[[DataFrame], DataFrame]]], to: int = SCHEMA_VERSION) -> DataFrame:
    """df of a version taken step by step (from, to, transform) to the version that is wanted."""
    if version > to:
        raise MigrationError(f"version {version} is newer than {to}")
    by_start, chain = {start: (end, f) for start, end, f in steps}, []
    while version < to:
        if version not in by_start:
            raise MigrationError(f"no step from version {version}")
        version, f = by_start[version]
        chain.append(f)
    return reduce(lambda d, f: f(d), chain, df)
