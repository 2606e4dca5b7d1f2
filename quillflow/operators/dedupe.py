"""Books that are the same under another title, and pages that belong to a book on the shelf."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions.text import trim
from quillflow.functions.titles import bigrams, chapter_number, jaccard, skeleton
from quillflow.schemas import CHAPTER_OK, chapter_state
from quillflow.sources.shared import settled

SAME_BOOK, SAME_PAGE = 0.75, 0.6
NEARLY, HIGHLY = "书名几乎一样", "书名高度相似"


def _by_rarity(titles: DataFrame) -> DataFrame:
    """s, n and by_rarity: the different bigrams (df, gram) of each of titles (s), in one order for all, from rare to frequent."""
    exploded = titles.withColumn("grams", bigrams(F.col("s"))).select("s", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    frequency = exploded.groupBy("gram").agg(F.count("*").alias("df"))
    return exploded.join(frequency, "gram").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("by_rarity"))


def title_pairs(books: DataFrame, similarity: float = SAME_BOOK) -> DataFrame:
    """skeleton_a, skeleton_b, similarity: different title skeletons whose bigrams are that similar, each pair once.

    Only different skeletons are compared, so books of one title are one row. Candidates share a bigram among their rarest: for a similarity of t two
    sets must share one of the first n - ceil(t * n) + 1 bigrams in an order common to both, here from rare to frequent.
    """
    titles = books.select(skeleton(F.coalesce("title", F.lit(""))).alias("s")).filter("s <> ''").distinct()
    ordered = _by_rarity(titles)
    prefix = F.slice("by_rarity", 1, F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1)
    probes = ordered.select("s", "n", F.explode(prefix).alias("p")).select("s", "n", F.col("p.gram").alias("gram"))
    a, b = probes.select("gram", F.col("s").alias("a"), F.col("n").alias("n_a")), probes.select("gram", F.col("s").alias("b"), F.col("n").alias("n_b"))
    sized = (F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a"))
    pairs = a.join(b, "gram").filter((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    score = jaccard(bigrams(F.col("a")), bigrams(F.col("b")))
    return pairs.withColumn("similarity", score).filter(F.col("similarity") >= similarity).select(F.col("a").alias("skeleton_a"), F.col("b").alias("skeleton_b"), "similarity")


def _rivals(classes: DataFrame, similarity: float) -> DataFrame:
    """earlier and later: classes (place, s, author) of one title, or similar ones, whose authors agree or of which one is missing."""
    pairs = title_pairs(classes.select(F.col("s").alias("title")), similarity).select(F.col("skeleton_a").alias("s"), F.col("skeleton_b").alias("t"))
    alike = pairs.unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))).unionByName(classes.select("s", F.col("s").alias("t")).distinct())
    left = alike.join(classes, "s").select("t", "author", F.col("place").alias("earlier"))
    right = classes.select(F.col("s").alias("t"), "author", F.col("place").alias("later"))
    # a missing author meets every other one of the title, but those do not meet each other
    met = [left.join(right, ["t", "author"])]
    met += [left.filter("author = ''").drop("author").join(right.filter("author <> ''"), "t"), left.filter("author <> ''").join(right.filter("author = ''").drop("author"), "t")]
    return reduce(DataFrame.unionByName, [m.select("earlier", "later") for m in met]).filter(F.col("earlier") < F.col("later"))


def duplicate_groups(books: DataFrame, similarity: float = SAME_BOOK) -> DataFrame:
    """book_id, group_id (the seed's book_id), keep (the book to keep) and reason of each book in a group of two or more.

    books: book_id, title, author, total_chapters, position (different for each). In the order of position each book not yet taken is a seed and takes all
    later ones of the same title (skeleton equal, or similar enough) whose author agrees with its own or is missing on either side.

    Books of one skeleton and author are always taken together, so only the first of each such class takes part, and a title that a third of all books
    has is a few rows of it. Who is a seed is found in rounds of joins: a class whose earlier rivals are all taken is a seed, one with a seed among
    them is taken; at last each goes to the earliest seed among its rivals. So no family of titles, however many are connected, meets in one task.
    """
    books = books.withColumn("s", skeleton(F.coalesce("title", F.lit(""))))
    rows = books.select("s", trim(F.coalesce("author", F.lit(""))).alias("author"), "book_id", F.coalesce("total_chapters", F.lit(0)).cast("long").alias("total"), F.col("position").cast("long").alias("position"))
    rows = settled(rows, "duplicates-books")
    classes = settled(rows.groupBy("s", "author").agg(F.min(F.struct("position", "book_id")).alias("place")), "duplicates-classes")
    rivals = settled(_rivals(classes, similarity), "duplicates-rivals")
    # open: pairs of undecided classes; a class that is not later in any of them, nor taken, is a seed
    open_, taken = rivals, None
    while not open_.isEmpty():
        seeds = open_.select(F.col("earlier").alias("place")).distinct().join(open_.select(F.col("later").alias("place")), "place", "left_anti")
        new = settled(open_.join(seeds, F.col("earlier") == F.col("place"), "left_semi").select(F.col("later").alias("place")).distinct(), "duplicates-taken")
        taken = new if taken is None else settled(taken.unionByName(new), "duplicates-taken")
        left = open_.join(new, F.col("earlier") == F.col("place"), "left_anti").join(new, F.col("later") == F.col("place"), "left_anti")
        open_ = settled(left.join(seeds, F.col("earlier") == F.col("place"), "left_anti"), "duplicates-open")
    seeded = rivals.join(taken, F.col("earlier") == F.col("place"), "left_anti") if taken is not None else rivals
    first = seeded.groupBy(F.col("later").alias("place")).agg(F.min("earlier").alias("seed"))
    seeds = classes.join(first, "place", "left").select("s", "author", F.coalesce("seed", "place")["book_id"].alias("group_id"))
    grouped = rows.join(seeds, ["s", "author"])
    best = grouped.groupBy("group_id").agg(F.min_by("book_id", F.struct((-F.col("total")).alias("n"), "position")).alias("keep"), F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n"))
    reason = F.when(F.col("a") == F.col("b"), NEARLY).otherwise(HIGHLY)
    return grouped.join(best.filter("n > 1").select("group_id", "keep", reason.alias("reason")), "group_id").select("book_id", "group_id", "keep", "reason")


def merge_duplicates(books: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of books, and what goes to the trash, for pairs (keep_id, drop_id): the one with more chapters stays, at a tie keep_id."""
    count = books.select("book_id", F.coalesce("total_chapters", F.lit(0)).alias("n"))
    both = pairs.filter("keep_id <> drop_id").join(count.toDF("keep_id", "n_keep"), "keep_id").join(count.toDF("drop_id", "n_drop"), "drop_id")
    gone = both.select(F.when(F.col("n_keep") >= F.col("n_drop"), F.col("drop_id")).otherwise(F.col("keep_id")).alias("book_id")).distinct()
    return books.join(gone, "book_id", "left_anti"), books.join(gone, "book_id", "left_semi")


def same_title(a: Column, b: Column, threshold: float = SAME_PAGE) -> Column:
    """Whether two skeletons name one book: equal, one within the other (two characters at least), or similar."""
    within = (F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) >= 2)
    return (a != "") & (b != "") & ((a == b) | within | (jaccard(bigrams(a), bigrams(b)) >= threshold))


def resolve_pages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """page_id, via (explicit, same-site, same-title, new), book_id and next_index: the book that each captured page belongs to.

    pages: page_id, host, title, book_id (null unless chosen); books: book_id, title, source_site, total_chapters, position. Different skeletons are compared once.
    Of two that are one, the shorter's rarest bigram is in the other where one is within the other, and they share a bigram among the first
    n - ceil(t * n) + 1 of each from rare to frequent where they are similar by t. So titles meet on rare bigrams, not on any.
    """
    # read several times below: pages are parsed once
    p = settled(pages.select("page_id", "host", "book_id", skeleton(F.col("title")).alias("s")), "page-titles")
    b = books.select(F.col("book_id").alias("_id"), "source_site", F.coalesce("total_chapters", F.lit(0)).alias("total"), "position", skeleton(F.col("title")).alias("t"))
    left, right = p.select("s").filter("s <> ''").distinct(), b.select(F.col("t").alias("s")).filter("s <> ''").distinct()
    ranked = _by_rarity(left.unionByName(right).distinct())
    rarest = F.element_at("by_rarity", 1)
    prefix = F.slice("by_rarity", 1, F.col("n") - F.ceil(F.col("n") * SAME_PAGE).cast("int") + 1)
    side = lambda titles, grams, name: ranked.join(titles, "s", "left_semi").select(F.col("s").alias(name), F.explode(grams).alias("p")).select(name, F.col("p.gram").alias("gram"))
    met = [side(left, x, "s").join(side(right, y, "t"), "gram").select("s", "t") for x, y in ((prefix, prefix), (F.array(rarest), F.col("by_rarity")), (F.col("by_rarity"), F.array(rarest)))]
    alike = reduce(DataFrame.unionByName, met).distinct().filter(same_title(F.col("s"), F.col("t")))
    first = b.groupBy("t", "source_site").agg(F.min_by(F.struct("_id", "total", "position"), F.struct("position", "_id")).alias("b"))
    candidates = p.join(alike, "s").join(first, "t")
    site = (F.col("source_site") == F.col("host")) & (F.col("host") != "")
    chosen = candidates.groupBy("page_id").agg(F.min(F.struct(F.when(site, 0).otherwise(1).alias("rank"), F.col("b.position").alias("position"), F.col("b._id").alias("id"), F.col("b.total").alias("total"))).alias("c"))
    explicit = p.join(b.select(F.col("_id").alias("book_id"), F.col("total").alias("own_total")), "book_id", "left")
    rows = explicit.join(chosen, "page_id", "left")
    named = F.col("own_total").isNotNull()
    via = F.when(named, "explicit").when(F.col("c.rank") == 0, "same-site").when(F.col("c.rank") == 1, "same-title").otherwise("new")
    return rows.select("page_id", via.alias("via"), F.when(named, F.col("book_id")).otherwise(F.col("c.id")).alias("book_id"), (F.coalesce(F.when(named, F.col("own_total")).otherwise(F.col("c.total")), F.lit(0)) + 1).cast("int").alias("next_index"))


def plan_captures(captures: DataFrame, chapters: DataFrame) -> DataFrame:
    """capture_id, action and chapter_index for captures (capture_id, book_id, title, content_hash) of books with chapters.

    A text that the book has is skipped; one whose number names a chapter that lacks its text fills it; one of a title that exists replaces it; others are
    appended.
    """
    c = captures.withColumns({"title": trim(F.coalesce("title", F.lit(""))), "number": chapter_number(F.col("title"))})
    by_hash = chapters.filter("coalesce(content_hash, '') <> ''").groupBy("book_id", "content_hash").agg(F.min("index").alias("same_text"))
    by_title = chapters.filter("title <> ''").groupBy("book_id", "title").agg(F.min("index").alias("same_title"))
    open_ = chapters.filter(chapter_state() != CHAPTER_OK).select("book_id", F.col("index").cast("long").alias("number"), F.lit(True).alias("open"))
    total = chapters.groupBy("book_id").agg(F.count("*").alias("total"))
    rows = c.join(by_hash, ["book_id", "content_hash"], "left").join(by_title, ["book_id", "title"], "left").join(open_, ["book_id", "number"], "left").join(total, "book_id", "left")
    fill = F.col("open").isNotNull() & (F.col("title") != "")
    action = F.when(F.col("same_text").isNotNull(), "skip").when(fill, "fill").when(F.col("same_title").isNotNull(), "replace").otherwise("append")
    place = F.when(F.col("same_text").isNotNull(), F.col("same_text")).when(fill, F.col("number")).when(F.col("same_title").isNotNull(), F.col("same_title")).otherwise(F.coalesce("total", F.lit(0)) + 1)
    return rows.select("capture_id", "book_id", action.alias("action"), place.cast("int").alias("chapter_index"))


def capture_counts(plans: DataFrame) -> DataFrame:
    """A row a book: captures to save and to skip."""
    return plans.groupBy("book_id").agg(F.count_if(F.col("action") != "skip").alias("saved"), F.count_if(F.col("action") == "skip").alias("skipped"))
