"""The shelf: books with their progress, in piles, filtered, counted, and the one to go on with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions.dates import millis
from quillflow.schemas import ALL_PILE, FINISHED, FOLLOWING, READING, UNREAD


def sort_key() -> Column:
    """When a book was last read, else changed, else made, in milliseconds."""
    last = lambda c: F.nullif(millis(F.col(c)), F.lit(0).cast("long"))
    return F.coalesce(last("last_read_at"), last("updatedAt"), last("created_at"), F.lit(0).cast("long"))


def decorate(books: DataFrame, progress: DataFrame) -> DataFrame:
    """books with their position (pos_*; null where there is none), progress_percent, update_badge and shelf_key.

    progress has a row a book. With a position, the percentage is what was saved or what the chapter says, whichever is more.
    """
    p = progress.select(F.col("book_id"), *[F.col(c).alias(f"pos_{c}") for c in ("chapter_index", "char_offset", "chapter_ratio", "percent", "updated_at")])
    total = F.col("total_chapters")
    by_chapter = F.when(total > 0, F.least(F.lit(1.0), (F.col("pos_chapter_index") - 1 + F.col("pos_chapter_ratio")) / total))
    by_count = F.when(total > 0, F.least(F.lit(1.0), F.col("read_chapters") / total)).otherwise(0.0)
    percent = F.when(F.col("pos_chapter_index").isNotNull(), F.greatest(F.col("pos_percent"), by_chapter)).otherwise(by_count)
    return books.join(p, "book_id", "left").withColumns({"progress_percent": F.round(percent, 3), "update_badge": F.greatest(F.col("new_chapters"), F.lit(0)), "shelf_key": sort_key()})


def ordered(decorated: DataFrame) -> DataFrame:
    return decorated.orderBy(F.col("shelf_key").desc(), "book_id")


def piles(decorated: DataFrame) -> DataFrame:
    """Each book once for every pile that it is in; piles overlap."""
    member = F.array_compact(F.array(
        F.when(F.col("status") == READING, READING),
        F.when((F.col("status") == FOLLOWING) | (F.col("update_badge") > 0), FOLLOWING),
        F.when(F.col("status") == FINISHED, FINISHED),
        F.lit(ALL_PILE),
    ))
    return decorated.withColumn("pile", F.explode(member))


def pile_counts(decorated: DataFrame) -> DataFrame:
    return piles(decorated).groupBy("pile").agg(F.count("*").alias("n_books"))


def filtered(books: DataFrame, status: str | None = None, tag: str | None = None, site: str | None = None, author: str | None = None, q: str | None = None) -> DataFrame:
    """Books that meet all the conditions given; q is looked for in title and author, whatever its case."""
    if status:
        books = books.filter(F.col("status") == status)
    if tag:
        books = books.filter(F.array_contains("tags", tag))
    if site:
        books = books.filter(F.col("source_site") == site)
    if author:
        books = books.filter(F.col("author") == author)
    if q and q.strip():
        needle = F.lit(q.strip().lower())
        books = books.filter(F.contains(F.lower("title"), needle) | F.contains(F.lower(F.coalesce("author", F.lit(""))), needle))
    return books


def facets(books: DataFrame) -> DataFrame:
    """facet and value: every tag, site, author and status there is. One pass, one shuffle."""
    one = lambda name, c: F.array(F.struct(F.lit(name).alias("facet"), c.alias("value")))
    tags = F.transform("tags", lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
    found = F.flatten(F.array(F.coalesce(tags, F.array().cast("array<struct<facet:string,value:string>>")), one("site", F.col("source_site")), one("author", F.col("author")), one("status", F.col("status"))))
    return books.select(F.explode(found).alias("f")).select("f.*").filter("value is not null and value <> ''").distinct()


def library_stats(books: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return books.agg(
        F.count("*").alias("n_books"), zero(F.sum("total_chapters")).alias("chapters"), zero(F.sum("read_chapters")).alias("read"), count(READING).alias("n_reading"), count(FOLLOWING).alias("n_following"),
        count(FINISHED).alias("n_finished"), count(UNREAD).alias("n_unread"), F.count("last_read_at").alias("n_with_reading"),
    )


def continue_reading(decorated: DataFrame, chapters: DataFrame) -> DataFrame:
    """The book read last that has a position, with its label and address: one row or none."""
    first = decorated.filter("pos_chapter_index is not null").orderBy(F.col("shelf_key").desc(), "book_id").limit(1)
    titles = chapters.select(F.col("book_id").alias("_book"), F.col("index").alias("_index"), F.col("title").alias("chapter_title"))
    joined = first.join(titles, (F.col("book_id") == F.col("_book")) & (F.col("pos_chapter_index") == F.col("_index")), "left")
    label = F.concat_ws(" · ", F.concat(F.lit("第 "), F.col("pos_chapter_index").cast("string"), F.lit(" 章")), "chapter_title")
    url = F.concat(F.lit("/reader.html?book="), F.replace(F.url_encode("book_id"), F.lit("+"), F.lit("%20")), F.lit("&ch="), F.col("pos_chapter_index").cast("string"))
    return joined.select(
        "book_id", "title", F.col("pos_chapter_index").alias("chapter_index"), F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), label.alias("label"),
        F.coalesce("last_read_at", "pos_updated_at").alias("last_read_at"), F.col("progress_percent").alias("percent"), url.alias("reader_url"),
    )
