"""Reading activity: positions, sessions, bookmarks, and the history of jumps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.functions.dates import day, week_start
from quillflow.functions.text import half_up
from quillflow.operators.folds import kept
from quillflow.schemas import FINISHED, READING, UNREAD

HISTORY_LIMIT, SESSION_LIMIT, NEAR = 500, 5000, 40


def latest(positions: DataFrame, *ties: str) -> DataFrame:
    """Each book's newest position; ties broken by further columns, highest first. Aggregated in the map before the shuffle."""
    columns = [c for c in positions.columns if c != "book_id"]
    order = F.struct(*["updated_at", *ties])
    return positions.groupBy("book_id").agg(F.max_by(F.struct(*columns), order).alias("p")).select("book_id", "p.*")


def recent(positions: DataFrame, n: int = 10) -> DataFrame:
    return positions.orderBy(F.col("updated_at").desc(), "book_id").limit(n)


def resolve(books: DataFrame, progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """Where each book opens: chapter_index, char_offset, chapter_ratio and the mode by which the saved position was carried over.

    books: book_id, total_chapters; progress: a row a book; chapters: book_id, index, char_count. The saved chapter and offset hold where they
    still exist; an offset beyond the chapter, or none beside a ratio, follows the ratio; a chapter beyond the book follows the percentage.
    """
    lengths = chapters.select(F.col("book_id").alias("_book"), F.col("index").alias("_index"), F.col("char_count").alias("_length"))
    p = books.select("book_id", "total_chapters").join(progress, "book_id", "left").join(lengths, (F.col("book_id") == F.col("_book")) & (F.col("chapter_index") == F.col("_index")), "left")
    total, length = F.coalesce("total_chapters", F.lit(0)), F.coalesce("_length", F.lit(0))
    mode = (
        F.when(F.col("chapter_index").isNull(), "fresh")
        .when(total <= 0, "empty")
        .when(F.col("chapter_index") > total, "by-percent")
        .when((length > 0) & ((F.col("char_offset") > length) | ((F.col("char_offset") == 0) & (F.col("chapter_ratio") > 0))), "by-ratio")
        .otherwise("exact")
    )
    p = p.withColumn("mode", mode)
    m = F.col("mode")
    by_percent = F.least(total, F.greatest(F.lit(1), F.ceil(F.col("percent") * total).cast("int")))
    index = F.when(m.isin("fresh", "empty"), 1).when(m == "by-percent", by_percent).otherwise(F.col("chapter_index"))
    offset = F.when(m == "exact", F.greatest(F.col("char_offset"), F.lit(0))).when(m == "by-ratio", half_up(F.col("chapter_ratio") * length).cast("int")).otherwise(0)
    # lengths of the chapter where a percentage leads are not looked up: the offset there is 0
    ratio = F.when(m.isin("fresh", "empty"), None).when(m == "by-percent", F.col("chapter_ratio")).when(length > 0, F.least(F.lit(1.0), offset / length)).otherwise(F.col("chapter_ratio"))
    return p.select("book_id", index.cast("int").alias("chapter_index"), offset.cast("int").alias("char_offset"), ratio.alias("chapter_ratio"), "mode")


def sync_books(books: DataFrame, progress: DataFrame) -> DataFrame:
    """books with last_read_at, read_chapters and status brought up to their positions."""
    p = progress.select("book_id", F.col("chapter_index").alias("_index"), F.col("updated_at").alias("_at"))
    joined = books.join(p, "book_id", "left")
    seen = F.col("_index").isNotNull()
    read = F.when(seen, F.greatest("read_chapters", "_index")).otherwise(F.col("read_chapters"))
    finished = (F.col("total_chapters") > 0) & (read >= F.col("total_chapters"))
    status = F.when(~seen, F.col("status")).when(finished, FINISHED).when(F.col("status").isin(UNREAD, FINISHED), READING).otherwise(F.col("status"))
    return joined.withColumns({"last_read_at": F.when(seen, F.col("_at")).otherwise(F.col("last_read_at")), "status": status, "read_chapters": F.least(read, "total_chapters")}).drop("_index", "_at")


def in_range(sessions: DataFrame, book_id: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sessions of a book and between two days, both included."""
    for value, test in ((book_id, F.col("book_id") == F.lit(book_id)), (since, F.col("day") >= F.lit(since)), (until, F.col("day") <= F.lit(until))):
        sessions = sessions.filter(test) if value else sessions
    return sessions


def totals(sessions: DataFrame, by: str | None = None) -> DataFrame:
    """ms and n_sessions: in all, or by day, book_id or week."""
    if by == "week":
        sessions = sessions.withColumn("week", week_start(F.col("started_at")))
    return sessions.groupBy(*([by] if by else [])).agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("ms"), F.count("*").alias("n_sessions"))


def overview(sessions: DataFrame) -> DataFrame:
    """Totals in all, by day and by book, of one pass; level names the grouping."""
    sets = sessions.groupingSets([["day"], ["book_id"], []], "day", "book_id").agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n_sessions"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "day").when(F.col("g") == 2, "book").otherwise("all")
    return sets.select(level.alias("level"), "day", "book_id", "ms", "n_sessions")


def week_total(sessions: DataFrame, now: Column) -> DataFrame:
    """Reading time from the Monday of now's week to now's day."""
    return totals(sessions.filter(F.col("day").between(week_start(now), day(now))))


def distinct_bookmarks(marks: DataFrame, order: str = "created_at") -> DataFrame:
    """marks without those that repeat an earlier one that was kept: same book, chapter and text, offsets at most one apart.

    Within a key, offsets ordered and cut where neighbours are over one apart fall into runs; runs are independent, and nearly always one or two
    rows. What is kept in a run depends on what was kept before, so each run, and no larger group, is folded.
    """
    key = ["book_id", "chapter_index", "selected_text"]
    w = Window.partitionBy(*key).orderBy("char_offset")
    starts = F.coalesce(F.col("char_offset") - F.lag("char_offset").over(w) > 1, F.lit(True)).cast("int")
    runs = marks.fillna({"selected_text": ""}).withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # equal offsets: only the first can be kept, which needs no fold
    exact = Window.partitionBy(*key, "char_offset").orderBy(order, "id")
    runs = runs.withColumn("_n", F.row_number().over(exact)).filter("_n = 1")
    alone = F.count("*").over(Window.partitionBy(*key, "_run"))
    sized = runs.withColumn("_size", alone)
    columns = marks.columns

    def start() -> Callable[[int], bool]:
        offsets: set[int] = set()

        def keep(offset: int) -> bool:
            new = not offsets & {offset - 1, offset, offset + 1}
            if new:
                offsets.add(offset)
            return new

        return keep

    folded = kept(sized.filter("_size > 1"), [*key, "_run"], [order, "id"], "char_offset", start)
    return sized.filter("_size = 1").select(*columns).unionByName(folded.select(*columns))


def push_history(entries: DataFrame, near: int = NEAR) -> DataFrame:
    """entries in order of (at, event_id) without jumps to about where the last kept one led: same book and chapter, fewer than `near` characters apart.

    The comparison is with the last entry kept, of any book. Where book or chapter changes an entry is kept whatever came before, so the whole order
    falls into stretches of one place, each folded on its own; only where a stretch begins is found over the whole order, hour by hour. Entries of no time
    come first.
    """
    columns = entries.columns
    ordered = entries.withColumn("_hour", F.coalesce(F.date_trunc("hour", "at"), F.lit("0001-01-01").cast("timestamp")))
    within = Window.partitionBy("_hour").orderBy("at", "event_id")
    place = F.struct("book_id", "chapter_index")
    before = F.lag(place).over(within)
    last = ordered.groupBy("_hour").agg(F.max_by(place, F.struct("at", "event_id")).alias("_place"))
    # a row an hour, which a calendar has few of: the place where the hour before ended
    carried = last.select("_hour", F.lag("_place").over(Window.orderBy("_hour")).alias("_carried"))
    moved = ordered.join(carried, "_hour").withColumn("_new", ~F.coalesce(F.coalesce(before, F.col("_carried")) == place, F.lit(False)))
    counts = moved.groupBy("_hour").agg(F.sum(F.col("_new").cast("int")).alias("_n"))
    offset = counts.select("_hour", F.coalesce(F.sum("_n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    numbered = moved.join(offset, "_hour").withColumn("_stretch", F.col("_offset") + F.sum(F.col("_new").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))

    def start() -> Callable[[int], bool]:
        last: list[int] = []

        def keep(offset: int) -> bool:
            new = not last or abs(offset - last[0]) >= near
            if new:
                last[:] = [offset]
            return new

        return keep

    return kept(numbered, ["_stretch"], ["at", "event_id"], "char_offset", start).select(*columns)


def newest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows, by a time and then all other columns."""
    return df.orderBy(F.col(by).desc(), *[c for c in df.columns if c != by]).limit(n)


def history_back(history: DataFrame, cursors: DataFrame) -> DataFrame:
    """The entry to which each book goes back: its next one behind the cursor, in the newest-first order of all books' entries.

    history: place (0 is the newest entry), book_id and what else is wanted; cursors: book_id, cursor.
    """
    at = history.join(cursors, "book_id").filter(F.col("place") > F.col("cursor"))
    rest = [c for c in history.columns if c != "book_id"]
    return at.groupBy("book_id").agg(F.min_by(F.struct(*rest), F.col("place")).alias("e")).select("book_id", "e.*")


def progress_export(progress: DataFrame, books: DataFrame) -> DataFrame:
    """Each position with its book's title and author (null for books that are gone) and the row as JSON."""
    rows = progress.join(books.select("book_id", "title", "author"), "book_id", "left")
    return rows.withColumn("json", F.to_json(F.struct(*rows.columns)))


def importable(progress: DataFrame, books: DataFrame) -> DataFrame:
    """Positions of books that exist."""
    return progress.filter("book_id is not null and book_id <> ''").join(books.select("book_id"), "book_id", "left_semi")


def throttle(reports: DataFrame, seconds: int = 2) -> DataFrame:
    """The last report of each book in each window of so many seconds."""
    window = F.window(F.col("updated_at"), f"{seconds} seconds")
    columns = [c for c in reports.columns if c != "book_id"]
    return reports.groupBy("book_id", window.alias("w")).agg(F.max_by(F.struct(*columns), F.struct("updated_at", "event_id")).alias("p")).select("book_id", "p.*")
