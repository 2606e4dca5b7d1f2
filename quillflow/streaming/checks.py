"""Checks for updates as a stream: what books' pages list goes in, and books with their notices come out, each batch in one commit and once.

A library is a bucket table of a row a book: the book, and its notices by type (the newest of each). So a book and its notice change together, whatever
fails: a batch whose commit succeeded is known by its number in the table, and one that failed is taken up again from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillflow.operators import schedule
from quillflow.sources.tables import BucketTable
from quillflow.streaming import reading as streams

UPDATE = "update"
NOTICE = "struct<at: timestamp, id: string, type: string, book_title: string, new_chapters: int, total_chapters: int, message: string, read: boolean>"


def message(title: Column, new: Column) -> Column:
    # Fixed value: what a notice of new chapters says.
    return F.concat(F.lit("《"), title, F.lit("》有 "), new.cast("string"), F.lit(" 章新内容，点开这条可以去更新。"))


def library(books: DataFrame) -> DataFrame:
    """The rows of a library: book_id, book (all columns of books) and notices (none)."""
    return books.select("book_id", F.struct(*books.columns).alias("book"), F.array().cast(f"array<{NOTICE}>").alias("notices"))


def after_check(library: DataFrame, links: DataFrame, chapters: DataFrame) -> DataFrame:
    """library after a check of the books in links (book_id, index, title, url, checked_at): marks of what is new, and a notice where something is.

    A book's notice of a type replaces the one before; nothing is fetched. Links of books that there are not change nothing.
    """
    at = links.groupBy("book_id").agg(F.max("checked_at").alias("_checked_at"))
    mine = library.join(at, "book_id", "left_semi")
    books = mine.select("book.*").join(at, "book_id")
    seen = schedule.checked(books, links.select("book_id", "index", "title", "url"), chapters, F.col("_checked_at"))
    found = F.col("new_chapters") > 0
    notice = F.struct(
        F.col("_checked_at").alias("at"), F.concat_ws("_", F.lit("nt"), F.lit(UPDATE), "book_id", F.unix_millis("_checked_at").cast("string")).alias("id"), F.lit(UPDATE).alias("type"), F.col("title").alias("book_title"),
        F.col("new_chapters").cast("int").alias("new_chapters"), F.col("total_chapters").cast("int").alias("total_chapters"), message(F.col("title"), F.col("new_chapters")).alias("message"), F.lit(False).alias("read"),
    )
    columns = library.select("book.*").columns
    seen = seen.withColumn("last_updated_at", F.when(found, F.col("_checked_at")).otherwise(F.col("last_updated_at"))) if "last_updated_at" in columns else seen
    checked = seen.select("book_id", F.struct(*columns).alias("_book"), F.when(found, notice).alias("_notice"))
    both = library.join(checked, "book_id", "left")
    others = F.filter("notices", lambda n: n["type"] != UPDATE)
    notices = F.when(F.col("_notice").isNull(), F.col("notices")).otherwise(F.concat(F.array(F.col("_notice").cast(NOTICE)), others))
    book_type = library.schema["book"].dataType
    return both.select("book_id", F.coalesce(F.col("_book").cast(book_type), F.col("book")).alias("book"), notices.alias("notices"))


def notices(library: DataFrame, most: int = schedule.NOTICES) -> DataFrame:
    """All books' notices, newest first, at most so many."""
    return library.select("book_id", F.explode("notices").alias("n")).select("book_id", "n.*").orderBy(F.col("at").desc(), "book_id", "type").limit(most)


def update_sink(table: BucketTable, chapters: Callable[[], DataFrame], stream: str = "checks") -> Callable[[DataFrame, int], None]:
    """For each batch of links: the library after their check, committed once under the stream's name."""

    def take(batch: DataFrame, n: int) -> None:
        touched = table.buckets_of(batch)
        if touched:
            table.change(touched, lambda old, _: after_check(old, batch, chapters()), batch=(stream, n))

    return take


def checking(links: DataFrame, table: BucketTable, chapters: Callable[[], DataFrame], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """The check as it runs: a batch each tick, never two at once."""
    return streams.ticking(links, update_sink(table, chapters), checkpoint, every)
