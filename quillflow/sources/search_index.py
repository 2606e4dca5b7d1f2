"""A search index that is kept: books that changed are indexed anew, books that are gone leave it, and a search opens only files that may hold what it looks for.

Two bucket tables by book: the chapters' collapsed texts, and beside them, small, what each chapter was made of (its content's hash, the version that
indexed it) and the places of its character pairs in a bitmap of so many bits, as a list. A search takes the chapters whose list has all pairs of what is
sought, reads only their buckets, and looks into their texts; a sought text of one character has no pair, and reads all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.operators import search
from quillflow.sources.tables import BUCKETS, BucketTable, Files

#: Bits of a chapter's bitmap: more than a chapter of usual length has different pairs.
BITS = 8192


def pair_places(text: Column) -> Column:
    """The places in the bitmap of a text's pairs of neighbouring characters, in lower case; each once, in order."""
    # the pairs that begin at odd places, and those at even ones; only different ones are hashed, as what is done to each element is interpreted
    lower = F.lower(text)
    pairs = [F.regexp_extract_all(part, F.lit("(?s).."), F.lit(0)) for part in (lower, F.substring(lower, 2, 2**31 - 1))]
    places = F.transform(F.array_distinct(F.concat(*pairs)), lambda pair: F.pmod(F.xxhash64(pair), F.lit(BITS)).cast("int"))
    return F.array_sort(F.array_distinct(places))


class KeptIndex:
    """The index of a library, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.texts = BucketTable(spark, f"{root.rstrip('/')}/texts", "book_id", buckets)
        self.marks = BucketTable(spark, f"{root.rstrip('/')}/marks", "book_id", buckets)

    def marked(self) -> DataFrame | None:
        return self.marks.read() if self.marks.version() else None

    def refresh(self, chapters: DataFrame) -> int:
        """Makes the index that of chapters (book_id, index, title, content, content_hash). Of books whose chapters are the same neither text nor pairs are computed again,
        and buckets of none that changed stay as they are. The version of the texts."""
        known = self.marked()
        changed = chapters.select("book_id").distinct() if known is None else search.outdated(known, chapters)
        # looked up several times below: found out once
        listed = f"changed/{uuid.uuid4().hex}"
        changed.write.parquet(f"{self.root}/{listed}")
        try:
            return self._renew(chapters, self.spark.read.schema(changed.schema).parquet(f"{self.root}/{listed}"), known is None)
        finally:
            Files(self.spark, self.root).delete(listed)

    def _renew(self, chapters: DataFrame, changed: DataFrame, first: bool) -> int:
        touched = self.texts.buckets_of(changed)
        if not touched and not first:
            return self.texts.version()

        def put(fresh: DataFrame, columns: Column | list) -> object:
            def new(old: DataFrame | None, version: int) -> DataFrame:
                rows = fresh.select(*columns).withColumn("version", F.lit(version))
                return rows if old is None else old.join(changed, "book_id", "left_anti").unionByName(rows)

            return new

        # a book that is gone has no chapters here, and so no new rows
        fresh = search.index(chapters.join(changed, "book_id", "left_semi"))
        version = self.texts.change(touched, put(fresh, ["book_id", "chapter_index", "chapter_title", "content_hash", "text"]))
        # the pairs are those of the texts as they were written
        written = self.texts.read(version, touched).join(changed, "book_id", "left_semi")
        self.marks.change(touched, put(written, ["book_id", "chapter_index", "content_hash", F.length("text").alias("n_chars"), pair_places(F.col("text")).alias("pairs")]))
        return version

    def candidates(self, q: str) -> DataFrame:
        """Chapters that may contain q, by their pairs alone."""
        wanted = pair_places(F.lit(" ".join(q.split())))
        return self.marks.read().filter(F.size(F.array_except(wanted, "pairs")) == 0).select("book_id", "chapter_index")

    def buckets(self, q: str) -> list[int]:
        """The buckets whose texts a search for q opens."""
        return self.texts.buckets_of(self.candidates(q))

    def matches(self, q: str) -> DataFrame:
        """search.matches of the kept texts: only buckets of candidates are read."""
        return search.matches(self.texts.read(buckets=self.buckets(q)), q)
