"""Chapter lists: states, diagnosis, comparison with snapshots, and edits that renumber."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.functions.text import chapter_file, char_count, content_hash, safe_name, trim
from quillflow.functions.titles import chapter_number
from quillflow.schemas import CHAPTER_FAILED, CHAPTER_OK, FETCH_DONE, FETCH_NONE, FETCH_PARTIAL, chapter_state

ISSUES = ("empty", "failed", "missing", "duplicate", "jump")


def _examined(chapters: DataFrame) -> DataFrame:
    """chapters with chapter_index (the place in the list), first_index, number_before and found: the types of their issues.

    chapters: book_id, position (anything that orders a book's list), title, char_count, is_ok, fetched_at. A book is one window, as its list is
    bounded by a book's length; books with most of the rows are split from others by the book's own key.
    """
    w = Window.partitionBy("book_id").orderBy("position")
    placed = chapters.withColumn("chapter_index", F.row_number().over(w)).withColumn("number", chapter_number(F.col("title")))
    before = F.last("number", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    name = F.nullif(trim("title"), F.lit(""))
    placed = placed.withColumns({"number_before": before, "name": name})
    placed = placed.withColumn("first_index", F.min("chapter_index").over(Window.partitionBy("book_id", "name")))
    empty = F.coalesce(F.col("char_count"), F.lit(0)) == 0
    broken = ~empty & ~F.col("is_ok")
    issue = lambda test, kind: F.when(test, kind)
    found = F.array_compact(F.array(
        issue(empty, "empty"),
        issue(broken & (chapter_state() == CHAPTER_FAILED), "failed"),
        issue(broken & (chapter_state() != CHAPTER_FAILED), "missing"),
        issue(F.col("name").isNotNull() & (F.col("chapter_index") > F.col("first_index")), "duplicate"),
        issue(F.col("number").isNotNull() & (F.col("number") != F.col("number_before") + 1), "jump"),
    ))
    return placed.withColumn("found", found)


def diagnose(chapters: DataFrame) -> DataFrame:
    """A row for each issue: book_id, chapter_index, title, type, and first_index or number_before where the type has them. As `_examined` otherwise."""
    rows = _examined(chapters).withColumn("type", F.explode("found"))
    return rows.select("book_id", "chapter_index", "title", "type", F.when(F.col("type") == "duplicate", F.col("first_index")).alias("first_index"), F.when(F.col("type") == "jump", F.col("number_before")).alias("number_before"))


def diagnosis(chapters: DataFrame) -> DataFrame:
    """A row a book: chapters in all, and issues of each type."""
    # the rows lie by book already, for the windows: they are counted where they are
    return _examined(chapters).groupBy("book_id").agg(F.count("*").alias("total"), *[F.count_if(F.array_contains("found", t)).alias(t) for t in ISSUES])


def fetch_status(chapters: DataFrame) -> DataFrame:
    """book_id, n_failed and fetch_status of each book."""
    rows = chapters.groupBy("book_id").agg(F.count_if(~F.col("is_ok")).alias("n_failed"), F.count("*").alias("n"))
    status = F.when(F.col("n_failed") == 0, FETCH_DONE).when(F.col("n_failed") == F.col("n"), FETCH_NONE).otherwise(FETCH_PARTIAL)
    return rows.select("book_id", "n_failed", status.alias("fetch_status"))


def snapshot(chapters: DataFrame, taken_at: Column) -> DataFrame:
    return chapters.select("book_id", taken_at.alias("taken_at"), "index", "title", "content_hash", "char_count")


def diff(current: DataFrame, before: DataFrame) -> DataFrame:
    """book_id, index, change (added, revised, removed, unchanged), titles and counts before and now, of books with a snapshot.

    Chapters are compared by place; a title alone is no revision, nor is a missing hash.
    """
    old = before.select("book_id", "index", F.col("title").alias("title_before"), F.col("content_hash").alias("hash_before"), F.col("char_count").alias("char_count_before"), F.lit(True).alias("was"))
    new = current.select("book_id", "index", "title", "content_hash", "char_count", F.lit(True).alias("is")).join(before.select("book_id").distinct(), "book_id", "left_semi")
    both = new.join(old, ["book_id", "index"], "full")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    revised = given("content_hash") & given("hash_before") & (F.col("content_hash") != F.col("hash_before"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(revised, "revised").otherwise("unchanged")
    return both.select("book_id", "index", change.alias("change"), "title_before", "title", "char_count_before", "char_count")


def neighbours(chapters: DataFrame) -> DataFrame:
    """The list of chapters without their texts, with the places before and after; null at the ends."""
    w = Window.partitionBy("book_id").orderBy("index")
    return chapters.select("book_id", "index", "title", "char_count", "is_ok", F.lag("index").over(w).alias("prev_index"), F.lead("index").over(w).alias("next_index"))


def states(chapters: DataFrame) -> DataFrame:
    return chapters.select("book_id", "index", "title", "char_count", chapter_state().alias("state"))


def renumbered(chapters: DataFrame, *order: str) -> DataFrame:
    """Chapters numbered from 1 without gaps, in the order of index and then order; order's columns go."""
    w = Window.partitionBy("book_id").orderBy("index", *order)
    return chapters.withColumn("index", F.row_number().over(w)).drop(*order)


def _with_text(chapters: DataFrame) -> DataFrame:
    return chapters.withColumns({"char_count": char_count("content"), "content_hash": content_hash("content")})


def _meeting(chapters: DataFrame, edits: DataFrame, how: str = "left") -> DataFrame:
    """Chapters beside the edit of their place; edits: book_id, at_index and others, few beside the chapters."""
    e = edits.withColumnsRenamed({"book_id": "_book"})
    return chapters.join(e, (F.col("book_id") == F.col("_book")) & (F.col("index") == F.col("at_index")), how).drop("_book")


def delete(chapters: DataFrame, places: DataFrame) -> DataFrame:
    """chapters without those at places (book_id, at_index); later ones move up."""
    return renumbered(_meeting(chapters, places.select("book_id", "at_index"), "left_anti"))


def rename(chapters: DataFrame, names: DataFrame) -> DataFrame:
    """chapters with new titles (book_id, at_index, new_title); an empty one changes nothing."""
    new = F.nullif(trim("new_title"), F.lit(""))
    return _meeting(chapters, names).withColumn("title", F.coalesce(new, "title")).drop("at_index", "new_title")


def split(chapters: DataFrame, cuts: DataFrame) -> DataFrame:
    """chapters with those at cuts (book_id, at_index, at_offset, new_title) in two; a null offset is the first line after the middle.

    A cut outside a chapter's text leaves it whole. Each part loses its line feeds at the cut.
    """
    joined = _meeting(chapters, cuts)
    text, size = F.coalesce("content", F.lit("")), F.length(F.coalesce("content", F.lit("")))
    middle = F.floor(size / 2).cast("int")
    feed = F.instr(F.substring(text, middle + 1, size), "\n")
    offset = F.when(F.col("at_index").isNotNull(), F.when(F.col("at_offset") > 0, F.col("at_offset")).otherwise(F.when(feed > 0, middle + feed).otherwise(middle)))
    cut = (offset > 0) & (offset < size)
    first = F.struct(F.lit(0).alias("_part"), F.col("title").alias("title"), F.regexp_replace(F.left(text, offset), "\n+$", "").alias("content"))
    second_title = F.coalesce(F.nullif(trim("new_title"), F.lit("")), F.concat("title", F.lit("（下）")))
    second = F.struct(F.lit(1).alias("_part"), second_title.alias("title"), F.regexp_replace(F.substring(text, offset + 1, size), "^\n+", "").alias("content"))
    whole = F.struct(F.lit(0).alias("_part"), F.col("title").alias("title"), F.col("content").alias("content"))
    parts = joined.withColumn("_p", F.explode(F.when(cut, F.array(first, second)).otherwise(F.array(whole))))
    rest = [c for c in chapters.columns if c not in ("title", "content", "char_count", "content_hash")]
    return renumbered(_with_text(parts.select(*rest, "_p.title", "_p.content", "_p._part")), "_part").select(*chapters.columns)


def merge(chapters: DataFrame, ranges: DataFrame) -> DataFrame:
    """chapters with each range (book_id, at_index, n, new_title; n at least 2, ranges of a book apart) as one, headed by the titles that it had.

    A range beyond the end of its book is not merged.
    """
    last = chapters.groupBy("book_id").agg(F.max("index").alias("_last"))
    valid = ranges.withColumn("n", F.greatest("n", F.lit(2))).join(last, "book_id").filter(F.col("at_index") + F.col("n") - 1 <= F.col("_last"))
    spans = valid.select(F.col("book_id").alias("_book"), F.col("at_index").alias("_from"), "n", "new_title")
    inside = (F.col("book_id") == F.col("_book")) & (F.col("index") >= F.col("_from")) & (F.col("index") < F.col("_from") + F.col("n"))
    marked = chapters.join(spans, inside, "left")
    part = F.struct("index", "title", F.concat_ws("\n\n", F.concat(F.lit("【"), "title", F.lit("】")), F.nullif(F.coalesce("content", F.lit("")), F.lit(""))).alias("body"))
    grouped = marked.filter("_from is not null").groupBy("book_id", "_from").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.first("new_title").alias("new_title"))
    title = F.coalesce(F.nullif(trim("new_title"), F.lit("")), F.concat(F.element_at("parts", 1)["title"], F.lit(" ～ "), F.element_at("parts", -1)["title"]))
    merged = grouped.select("book_id", F.col("_from").alias("index"), title.alias("title"), F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("content"))
    merged = merged.withColumns({"is_ok": F.lit(True), "origin": F.lit("manual")})
    kept = marked.filter("_from is null").select(*chapters.columns)
    return renumbered(kept.unionByName(_with_text(merged), allowMissingColumns=True)).select(*chapters.columns)


def source_text(chapters: DataFrame) -> DataFrame:
    """book_id and text: titles and contents of a book in order, with blank lines between, for another division into chapters."""
    part = F.struct("index", F.concat_ws("\n\n", "title", F.nullif(F.coalesce("content", F.lit("")), F.lit(""))).alias("body"))
    joined = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return joined.select("book_id", F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("text"))


def export_text(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id and text: a head of title, author, source and introduction, then the chapters; at most two blank lines anywhere."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    head = F.concat_ws("\n", "title", line("作者：", "author"), line("来源：", "source_site"), line("", "intro") if "intro" in books.columns else F.lit(None))
    body = source_text(chapters.select("book_id", "index", "title", "content"))
    rows = books.select("book_id", head.alias("head")).join(body, "book_id", "left")
    return rows.select("book_id", F.regexp_replace(F.concat_ws("\n\n", "head", "text"), "\n{4,}", "\n\n\n").alias("text"))


def export_json(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id and json: the book with its chapters and their texts in an envelope."""
    rows = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("index", "title", "char_count", "content_hash", "content"))).alias("chapters"))
    fields = [c for c in books.columns if c != "chapters"]
    whole = books.join(rows, "book_id", "left")
    return whole.select("book_id", F.to_json(F.struct(F.lit("book-export").alias("format"), F.lit(1).alias("version"), F.struct(*fields, F.coalesce("chapters", F.array().cast("array<struct<index:int,title:string,char_count:int,content_hash:string,content:string>>")).alias("chapters")).alias("book"))).alias("json"))


def verify(chapters: DataFrame, expected: DataFrame) -> DataFrame:
    """A row a book: n_expected, n_found, first_difference (the first place where titles differ; null if none), ok. Both: book_id, index, title."""
    want = expected.select("book_id", "index", F.col("title").alias("want"))
    both = chapters.select("book_id", "index", F.col("title").alias("got")).join(want, ["book_id", "index"], "full")
    rows = both.groupBy("book_id").agg(F.count("want").alias("n_expected"), F.count("got").alias("n_found"), F.min(F.when(~F.col("want").eqNullSafe(F.col("got")), F.col("index"))).alias("first_difference"))
    return rows.withColumn("ok", (F.col("n_expected") == F.col("n_found")) & F.col("first_difference").isNull())


def unfinished(chapters: DataFrame) -> DataFrame:
    """Chapters that a resumed fetch has still to get."""
    return chapters.filter(chapter_state() != CHAPTER_OK)


def export_chapters(chapters: DataFrame) -> DataFrame:
    """book_id, index, path (where a library keeps the text), file (a name to save it under) and text of each chapter."""
    return chapters.select("book_id", "index", F.concat_ws("/", F.lit("books"), "book_id", F.lit("chapters"), chapter_file("index")).alias("path"), F.concat(safe_name("title"), F.lit(".txt")).alias("file"), F.coalesce("content", F.lit("")).alias("text"))


def with_issues(chapters: DataFrame) -> DataFrame:
    """Only the places that the diagnosis found something at, each once, with what it found."""
    return diagnose(chapters).groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_set("type")).alias("types"))
