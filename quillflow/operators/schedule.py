"""Update checks: which books are due, what is new on their pages, and the notices of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.functions.dates import next_check
from quillflow.functions.titles import skeleton
from quillflow.schemas import FOLLOWING

NOTICES = 200


def due(books: DataFrame, now: Column, force: bool = False, include_manual: bool = False) -> DataFrame:
    """Books with a page whose time has come; all of them by force, those checked by hand only by force and wish."""
    rhythmic = F.coalesce("check_mode", F.lit("manual")) != "manual"
    arrived = F.lit(force) | F.col("next_check_at").isNull() | (F.col("next_check_at") <= now)
    return books.filter(F.col("toc_url").isNotNull() & ((rhythmic & arrived) | (~rhythmic & F.lit(force and include_manual))))


def new_links(links: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, index, title, url of links (book_id, index, title, url) that are new chapters.

    A title that the book has is not new; one at the place of another title is a change of title, not new; each url counts once. Titles
    are compared without white space, punctuation and case.
    """
    key = lambda c: skeleton(c, brackets=False)
    have = chapters.select("book_id", key(F.col("title")).alias("key"))
    at = chapters.select("book_id", "index", key(F.col("title")).alias("there"))
    unknown = links.withColumn("key", key(F.col("title"))).filter("key <> ''").join(have.distinct(), ["book_id", "key"], "left_anti")
    placed = unknown.join(at, ["book_id", "index"], "left").filter(F.coalesce("there", F.lit("")) == "")
    first = Window.partitionBy("book_id", "url").orderBy("index")
    return placed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("book_id", "index", "title", "url")


def title_changes(links: DataFrame, chapters: DataFrame) -> DataFrame:
    """Places where the page has an unknown title and the book another one."""
    key = lambda c: skeleton(c, brackets=False)
    have = chapters.select("book_id", key(F.col("title")).alias("key")).distinct()
    at = chapters.select("book_id", "index", F.col("title").alias("title_before"))
    unknown = links.withColumn("key", key(F.col("title"))).filter("key <> ''").join(have, ["book_id", "key"], "left_anti")
    return unknown.join(at, ["book_id", "index"]).filter((key(F.col("title_before")) != "") & (key(F.col("title_before")) != F.col("key"))).select("book_id", "index", "title_before", "title")


def checked(books: DataFrame, links: DataFrame, chapters: DataFrame, now: Column) -> DataFrame:
    """books after a check: new_chapters, status, last_checked_at and next_check_at; nothing is fetched."""
    found = new_links(links, chapters).groupBy("book_id").agg(F.count("*").alias("_new"))
    seen = links.select("book_id").distinct().withColumn("_seen", F.lit(True))
    rows = books.join(seen, "book_id", "left").join(found, "book_id", "left")
    new, was = F.coalesce("_new", F.lit(0)).cast("int"), F.col("_seen").isNotNull()
    return rows.withColumns({
        "new_chapters": F.when(was, new).otherwise(F.col("new_chapters")), "status": F.when(new > 0, FOLLOWING).otherwise(F.col("status")), "last_checked_at": F.when(was, now),
        "next_check_at": F.when(was, next_check(F.col("check_mode"), now)).otherwise(F.col("next_check_at")),
    }).drop("_new", "_seen")


def latest_notices(notices: DataFrame, most: int = NOTICES, *ties: str) -> DataFrame:
    """The newest notice of each book and type, newest first, at most so many."""
    columns = [c for c in notices.columns if c not in ("book_id", "type")]
    one = notices.groupBy("book_id", "type").agg(F.max_by(F.struct(*columns), F.struct("at", *ties)).alias("n")).select("book_id", "type", "n.*")
    return one.orderBy(F.col("at").desc(), "book_id", "type").limit(most)


def mark_read(notices: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """notices with those of ids (id), or all, marked as read."""
    if ids is None:
        return notices.withColumn("read", F.lit(True))
    marked = ids.select("id").distinct().withColumn("_r", F.lit(True))
    return notices.join(marked, "id", "left").withColumn("read", F.col("read") | F.col("_r").isNotNull()).drop("_r").select(*notices.columns)


def unread(notices: DataFrame) -> DataFrame:
    """Notices that nobody has read, a null mark counting as unread."""
    return notices.filter(~F.coalesce("read", F.lit(False)))
