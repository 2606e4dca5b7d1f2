"""Queries that run a stream over a table to its end and return what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.plans import entities as E
from quillflow.sources.shared import fresh_dir
from quillflow.streaming import reading as streams
from quillflow.streaming import states

QUERIES, ORACLES = {}, {}


def _drained(stream: DataFrame, keep) -> DataFrame:
    """The sink's rows at the stream's end. keep: from a batch to the rows to hold, all of those before being replaced (complete mode)."""
    spark, folder = stream.sparkSession, fresh_dir(stream.sparkSession, "stream")
    schema = keep(stream).schema
    written: list[str] = []

    def sink(batch: DataFrame, n: int) -> None:
        keep(batch).write.mode("overwrite").parquet(f"{folder}/out/{n}")
        written.append(f"{folder}/out/{n}")

    streams.drain(stream, sink, f"{folder}/checkpoint", "complete").awaitTermination()
    return spark.read.schema(schema).parquet(written[-1]) if written else spark.createDataFrame([], schema)


def _appended(stream: DataFrame) -> DataFrame:
    """All rows that the stream has given at its end."""
    spark, folder = stream.sparkSession, fresh_dir(stream.sparkSession, "stream")
    streams.drain(stream, states.batch_files(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pattern lets the source take a table that is one file
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    s = e.select(F.col("user_id").cast("string").alias("book_id"), F.col("ts").cast("timestamp").alias("started_at"), F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("duration_ms"))
    return _drained(streams.by_window(s), lambda df: df.select(F.date_format("since", "yyyy-MM-dd").alias("day"), "ms", "n_sessions"))


def stream_latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    p = e.select(F.col("user_id").cast("string").alias("book_id"), (F.col("event_id") % 60 + 1).cast("int").alias("chapter_index"), F.col("ts").alias("updated_at"), "event_id")
    return _drained(streams.latest_positions(p), lambda df: df.select("book_id", "chapter_index", "event_id"))


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's jumps in order, without those to about where the last kept one led, by a state for each user."""
    i = F.col("event_id")
    jumps = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("owner_id"), F.floor(i / 1000).cast("string").alias("book_id"), (F.floor(i / 250) % 5 + 1).cast("int").alias("chapter_index"), (i * 13 % 90).cast("int").alias("char_offset"),
        F.col("ts").alias("at"), "event_id",
    )
    return _appended(states.kept_jumps(jumps, late="0 seconds"))


def stream_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to hosts, one a type: which of them fetch their host's rules anew, these being good for ten minutes."""
    requests = _events(spark, sf_dir).select(F.col("event_type").alias("host"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return _appended(states.robots_fetches(requests, late="0 seconds"))


def stream_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads and commits of users: which commits still find an upload of the last two hours."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("upload_id"), F.col("ts").alias("at"), "event_id", (F.col("event_id") % 3 > 0).alias("is_upload"))
    return _appended(states.staged_uploads(e, late="0 seconds"))


QUERIES |= {f.__name__: f for f in (stream_by_day, stream_latest_positions, stream_history, stream_robots, stream_staging)}
ORACLES |= {
    "stream_history": """with recursive e as (select cast(user_id as varchar) as owner_id, cast(event_id // 1000 as varchar) as book_id, cast(event_id // 250 % 5 + 1 as integer) as chapter_index, cast(event_id * 13 % 90 as integer) as char_offset, epoch_us(ts) // 1000 as at_ms, event_id from events),
  m as (select *, row_number() over (partition by owner_id order by at_ms, event_id) as k from e),
  walk as (select *, true as stays, book_id as b, chapter_index as c, char_offset as o from m where k = 1 union all
    select m.*, not (m.book_id = w.b and m.chapter_index = w.c and abs(m.char_offset - w.o) < 40), m.book_id, m.chapter_index,
      case when m.book_id = w.b and m.chapter_index = w.c and abs(m.char_offset - w.o) < 40 then w.o else m.char_offset end from walk w join m on m.owner_id = w.owner_id and m.k = w.k + 1)
  select owner_id, book_id, chapter_index, char_offset, at_ms, event_id from walk where stays""",
    "stream_robots": """with recursive e as (select event_type as host, epoch_us(ts) // 1000 as at_ms, event_id as request_id from events),
  fetches as (select host, min(at_ms) as since from e group by host union all
    select f.host, (select min(e.at_ms) from e where e.host = f.host and e.at_ms >= f.since + 600000) from fetches f where f.since is not null),
  met as (select e.*, since from e asof join (select * from fetches where since is not null) f on e.host = f.host and e.at_ms >= f.since)
  select host, request_id, at_ms, since = at_ms and row_number() over (partition by host, at_ms order by request_id) = 1 as fetch, since as rules_at_ms from met""",
    "stream_staging": """with e as (select user_id as upload_id, epoch_us(ts) // 1000 as at_ms, event_id, event_id % 3 > 0 as is_upload from events),
  m as (select *, max(case when is_upload then at_ms end) over (partition by upload_id order by at_ms, event_id rows between unbounded preceding and 1 preceding) as since from e)
  select upload_id, event_id, at_ms, coalesce(at_ms - since < 7200000, false) as found from m where not is_upload""",
    "stream_by_day": f"with {E.SESSIONS_SQL} select day, cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions group by day",
    "stream_latest_positions": f"with {E.POSITIONS_SQL} select book_id, chapter_index, event_id from positions qualify row_number() over (partition by book_id order by updated_at desc, chapter_index desc, event_id desc) = 1",
}
