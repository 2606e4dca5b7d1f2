"""Full-text search by substring: no tokens, no relevance; results in the order of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions.text import collapse, positions, snippet

MOST_POSITIONS, SNIPPETS, PAD = 200, 3, 34
#: Characters by which a short query is met where there are many of them, and how many may be looked for in each text in turn.
SEED, FEW = 2, 256


class SearchError(ValueError):
    """An empty query, or a scope without its book."""


def index(chapters: DataFrame) -> DataFrame:
    """The search table: chapters with texts whose white space is collapsed. Written partitioned by book it can be replaced book by book."""
    return chapters.select("book_id", F.col("index").alias("chapter_index"), F.col("title").alias("chapter_title"), "content_hash", collapse("content").alias("text"))


def index_status(indexed: DataFrame, books: DataFrame) -> DataFrame:
    """Books that are not in the index (missing) and books in the index that are gone (stale), and the characters indexed of the others."""
    have = indexed.groupBy("book_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count("*").alias("n_chapters"))
    both = books.select("book_id", F.lit(True).alias("on_shelf")).join(have, "book_id", "full")
    state = F.when(F.col("on_shelf").isNull(), "stale").when(F.col("n_chapters").isNull(), "missing").otherwise("indexed")
    return both.select("book_id", state.alias("state"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"))


def outdated(indexed: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_ids whose chapters differ from what was indexed: these alone are indexed again."""
    now = chapters.select("book_id", F.col("index").alias("chapter_index"), F.col("content_hash").alias("now"))
    both = now.join(indexed.select("book_id", "chapter_index", F.col("content_hash").alias("then")), ["book_id", "chapter_index"], "full")
    return both.filter(~F.col("now").eqNullSafe(F.col("then"))).select("book_id").distinct()


def matches(indexed: DataFrame, q: str, book_id: str | None = None, scope: str = "library") -> DataFrame:
    """Chapters that contain q, whatever its case, with `at` (its places) in their collapsed texts. The cheap test comes first."""
    needle = (q or "").strip().lower()
    if not needle:
        raise SearchError("empty query")
    if scope == "book":
        if not book_id:
            raise SearchError("the scope is a book, and none is named")
        indexed = indexed.filter(F.col("book_id") == book_id)
    lower = F.lower("text")
    return indexed.filter(F.contains(lower, F.lit(needle))).withColumn("at", positions(lower, F.lit(needle), MOST_POSITIONS))


def snippets(found: DataFrame, q: str) -> DataFrame:
    """The first matches of each chapter with their surroundings."""
    first = found.withColumn("_at", F.explode(F.slice("at", 1, SNIPPETS)))
    return first.select("book_id", "chapter_index", "chapter_title", F.size("at").alias("n_hits"), F.col("_at").alias("position"), snippet(F.col("text"), F.col("_at"), F.lit(len(q.strip())), PAD).alias("s")).select(
        "book_id", "chapter_index", "chapter_title", "n_hits", "position", "s.*"
    )


def search(indexed: DataFrame, library: DataFrame, q: str, limit: int = 100, book_id: str | None = None, scope: str = "library") -> DataFrame:
    """A row a book: hits, chapters with hits. library: book_id, title, author, position (its order); limit counts books, 1 to 500, 0 is 100."""
    most = max(1, min(500, limit or 100))
    by_book = matches(indexed, q, book_id, scope).groupBy("book_id").agg(F.sum(F.size("at")).alias("n_hits"), F.count("*").alias("n_chapters"))
    return by_book.join(library, "book_id").orderBy("position").limit(most).select("book_id", "title", "author", "n_hits", "n_chapters", "position")


def search_totals(results: DataFrame, limit: int = 100) -> DataFrame:
    most = max(1, min(500, limit or 100))
    return results.agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("total_hits"), F.count("*").alias("matched_books")).withColumn("truncated", F.col("matched_books") >= most)


def _starts(text: str, n: int) -> Column:
    """The different characters of a text, or pairs of neighbouring ones (n is SEED at most), in one pass over it."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if n == 1:
        return F.array_distinct(chars)
    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(pairs))


def search_many(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """Which of many queries (query_id, q) each text (text_id, text; ids differ) contains, with the number of times. An empty query is in no text.

    A query's longest inner word is a whole word wherever the query occurs, so texts meet such queries on their different words. A query of one or two
    words may begin or end within a word: FEW of these are looked for in each text as it goes by; where there are more, they are met on their first
    characters, SEED of them or what they have, of which texts list their different ones. Only keys and ids take part in these joins; whole texts are met by the
    pairs that they find, and verified. A frequent word joins as a skewed key.
    """
    asked = queries.select("query_id", collapse(F.lower("q")).alias("_q")).filter("_q <> ''")
    words = F.split("_q", " ")
    inner = F.slice(words, 2, F.size(words) - 2)
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    by_word = asked.filter(F.size(words) >= 3).withColumn("_key", longest)
    by_start = asked.filter(F.size(words) < 3).withColumn("_key", F.left("_q", F.lit(SEED)))
    bodies = texts.select("text_id", collapse(F.lower("text")).alias("_body"))
    times = (F.length("_body") - F.length(F.replace(F.col("_body"), F.col("_q"), F.lit("")))) / F.length("_q")
    counted = lambda pairs: pairs.select("text_id", "query_id", times.cast("int").alias("n_hits"))
    few = by_start.select("query_id", "_q").limit(FEW + 1).collect()
    met = bodies.select("text_id", F.explode(F.array_distinct(F.split("_body", " "))).alias("_key")).join(by_word, "_key")
    if 0 < len(few) <= FEW:
        kind = by_start.schema["query_id"].dataType
        listed = F.array(*[F.struct(F.lit(r.query_id).cast(kind).alias("query_id"), F.lit(r._q).alias("_q")) for r in few])
        found = bodies.withColumn("_x", F.explode(F.filter(listed, lambda x: F.contains("_body", x["_q"])))).select("text_id", "_body", "_x.*")
        return counted(found).unionByName(counted(met.select("text_id", "query_id", "_q").join(bodies, "text_id").filter(F.contains("_body", "_q"))))
    for n in sorted(r.n for r in by_start.select(F.length("_key").alias("n")).distinct().collect()):  # SEED numbers at most
        parts = bodies.filter(F.length("_body") >= n).select("text_id", F.explode(_starts("_body", n)).alias("_key"))
        met = met.unionByName(parts.join(by_start.filter(F.length("_key") == n), "_key"))
    return counted(met.select("text_id", "query_id", "_q").join(bodies, "text_id").filter(F.contains("_body", "_q")))


def highlighted(s: Column, size: int) -> Column:
    """A snippet as text with its match in brackets."""
    at = s["offset_in_snippet"]
    return F.concat(F.left(s["text"], at), F.lit("["), F.substring(s["text"], at + 1, F.lit(size)), F.lit("]"), F.substring(s["text"], at + size + 1, F.length(s["text"])))
