"""Queries over tables and indexes that are kept and changed, and streams that change them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.plans import entities as E
from quillflow.plans.library_queries import BASE, _books
from quillflow.sources.search_index import KeptIndex
from quillflow.sources.shared import fresh_dir
from quillflow.sources.tables import BucketTable
from quillflow.streaming import checks
from quillflow.streaming import reading as streams

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Documents as chapters, ten a book; later one in a hundred has more text, and every fiftieth book is gone.
DOCUMENTS_SQL = f"""docs as (select cast(doc_id // 10 as varchar) as book_id, cast(doc_id % 10 + 1 as integer) as chapter_index, coalesce(text, '') as text, doc_id % 100 = 7 as changes, doc_id // 10 % 50 = 49 as goes from documents),
  later as (select book_id, chapter_index, case when changes then text || ' and a Zwieback at the end' else text end as text from docs where not goes),
  kept as (select l.*, trim(regexp_replace(l.text, '{E.RE2_WS}+', ' ', 'g')) as body, case when book_id in (select book_id from docs where changes) then 2 else 1 end as version from later l)"""


def _kept(spark: SparkSession, sf_dir: str) -> KeptIndex:
    """The index of the documents, made and then brought up to date."""
    d, i = E.table(spark, sf_dir, "documents"), F.col("doc_id")
    chapters = d.select(F.floor(i / 10).cast("string").alias("book_id"), (i % 10 + 1).cast("int").alias("index"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("content"), (i % 100 == 7).alias("changes"), (F.floor(i / 10) % 50 == 49).alias("goes"))
    hashed = lambda rows: rows.withColumn("content_hash", F.sha1("content"))
    later = chapters.filter("not goes").withColumn("content", F.when(F.col("changes"), F.concat("content", F.lit(" and a Zwieback at the end"))).otherwise(F.col("content")))
    kept = KeptIndex(spark, fresh_dir(spark, "index"))
    kept.refresh(hashed(chapters))
    kept.refresh(hashed(later))
    return kept


@query(f"with {DOCUMENTS_SQL} select book_id, chapter_index, version, cast(length(body) as integer) as n_chars, md5(body) as body_md5 from kept")
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after it was brought up to date, and by which of the two it was indexed."""
    return _kept(spark, sf_dir).texts.read().select("book_id", "chapter_index", "version", F.length("text").alias("n_chars"), F.md5("text").alias("body_md5"))


@query(f"with {DOCUMENTS_SQL} select book_id, chapter_index from kept where contains(lower(body), 'a zwieback at')")
def kept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of the kept index: files of books whose pairs do not fit are not opened."""
    return _kept(spark, sf_dir).matches("a Zwieback at").select("book_id", "chapter_index")


@query(f"""with {E.BOOKS_SQL}, b as (select {BASE}, least(read_raw, total_chapters) as read_chapters, cast(book_id as bigint) as k from books)
  select book_id, case when k % 5 = 0 then title || ' new' when k % 7 = 0 then 'patched' else title end as title, author, case when k % 5 = 0 then 3 else total_chapters end as total_chapters from b where (k % 2 = 0 or k % 5 = 0) and k % 11 <> 0""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a table after four commits: half of them, then new and changed ones, patches, and removals."""
    b, k = _books(spark, sf_dir).select("book_id", "title", "author", "total_chapters"), F.col("book_id").cast("long")
    table = BucketTable(spark, fresh_dir(spark, "table"), buckets=16)
    table.upsert(b.filter(k % 2 == 0))
    table.upsert(b.filter(k % 5 == 0).withColumns({"title": F.concat("title", F.lit(" new")), "total_chapters": F.lit(3)}))
    table.patch(b.filter((k % 7 == 0) & (k % 5 != 0)).select("book_id", F.lit("patched").alias("title"), F.lit(None).cast("string").alias("author")))
    table.remove(b.filter(k % 11 == 0))
    return table.read()


@query("""with c as (select conv_id, turn, cast(conv_id as varchar) as book_id, cast(turn + 1 as integer) as idx, 'Part ' || (turn + 1) as title from conversations),
  known as (select * from c where turn % 3 <> 2), books as (select book_id, count(*) as total from known group by book_id), fresh as (select book_id, count(*) as n from c where turn % 3 = 2 group by book_id)
  select b.book_id, coalesce(n, 0) as new_chapters, case when n > 0 then '《Book ' || b.book_id || '》有 ' || n || ' 章新内容，点开这条可以去更新。' end as message from books b left join fresh f using (book_id)""")
def update_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of all books by a stream of their pages' links, of which every third is new: the books' marks and notices, committed together."""
    t = F.col("turn")
    listed = E.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), (t + 1).cast("int").alias("index"), F.concat(F.lit("Part "), (t + 1).cast("string")).alias("title"), t)
    chapters = listed.filter(t % 3 != 2).drop("turn")
    books = chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("total_chapters")).withColumn("title", F.concat(F.lit("Book "), "book_id"))
    books = books.withColumns({"new_chapters": F.lit(0), "status": F.lit("x"), "last_checked_at": F.lit(None).cast("timestamp"), "next_check_at": F.lit(None).cast("timestamp"), "last_updated_at": F.lit(None).cast("timestamp"), "check_mode": F.lit("daily")})
    folder = fresh_dir(spark, "checks")
    table = BucketTable(spark, f"{folder}/library", buckets=16)
    table.upsert(checks.library(books))
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    links = stream.select(
        F.col("conv_id").cast("string").alias("book_id"), (t + 1).cast("int").alias("index"), F.concat(F.lit("Part "), (t + 1).cast("string")).alias("title"), F.concat(F.lit("http://h.example/"), "conv_id", F.lit("/"), t.cast("string")).alias("url"),
        F.lit("2024-02-01").cast("timestamp").alias("checked_at"),
    )
    streams.drain(links, checks.update_sink(table, lambda: chapters), f"{folder}/checkpoint").awaitTermination()
    return table.read().select("book_id", F.col("book.new_chapters").cast("long").alias("new_chapters"), F.try_element_at("notices", F.lit(1))["message"].alias("message"))


