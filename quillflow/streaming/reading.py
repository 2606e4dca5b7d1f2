"""Reading activity as streams: totals by day, latest positions, notices, queued captures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillflow.operators import dedupe, reading, schedule


def by_window(sessions: DataFrame, length: str = "1 day", late: str = "2 days", *keys: str) -> DataFrame:
    """Totals of sessions (started_at, duration_ms) by window and keys; sessions later than `late` are left out, so state is bounded."""
    rows = sessions.withWatermark("started_at", late).groupBy(F.window("started_at", length).alias("w"), *keys)
    return rows.agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n_sessions")).select(F.col("w.start").alias("since"), *keys, "ms", "n_sessions")


def sittings(sessions: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a book that follow each other within the gap, as one."""
    rows = sessions.withWatermark("started_at", late).groupBy("book_id", F.session_window("started_at", gap).alias("w"))
    return rows.agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n_sessions")).select("book_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "ms", "n_sessions")


def latest_positions(positions: DataFrame) -> DataFrame:
    """Each book's newest position so far; for output mode update or complete."""
    columns = [c for c in positions.columns if c != "book_id"]
    return positions.groupBy("book_id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", *[c for c in columns if c != "updated_at"])).alias("p")).select("book_id", "p.*")


def throttled(reports: DataFrame, seconds: int = 2, late: str = "10 seconds") -> DataFrame:
    """The last report of each book in each window."""
    columns = [c for c in reports.columns if c not in ("book_id",)]
    rows = reports.withWatermark("updated_at", late).groupBy("book_id", F.window("updated_at", f"{seconds} seconds").alias("w"))
    return rows.agg(F.max_by(F.struct(*columns), F.struct(*columns)).alias("p")).select("book_id", "p.*")


def unrepeated(captures: DataFrame, late: str = "1 day") -> DataFrame:
    """Captures of a queue that is sent again, each text of a book once."""
    return captures.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["book_id", "content_hash"])


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take all that has come, batch by batch, and stop; the next call goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def ticking(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """A batch each tick; a batch that runs longer delays the next, two never overlap."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()


def notices_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], most: int = schedule.NOTICES) -> Callable[[DataFrame, int], None]:
    """For each batch of notices: merged with those there are, the newest of each book and type, at most so many."""

    def take(batch: DataFrame, _: int) -> None:
        before = read()
        write(schedule.latest_notices(batch if before is None else before.unionByName(batch), most))

    return take


def captures_sink(chapters: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For each batch of captures: where each one goes in its book."""

    def take(batch: DataFrame, _: int) -> None:
        write(dedupe.plan_captures(batch, chapters()))

    return take


def positions_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For each batch of positions: each book's newest, of the batch and before."""

    def take(batch: DataFrame, _: int) -> None:
        before = read()
        write(reading.latest(batch if before is None else before.unionByName(batch)))

    return take


def history_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], most: int = reading.HISTORY_LIMIT) -> Callable[[DataFrame, int], None]:
    """For each batch of jumps: put behind those that were kept, without those to about where the last one led; the newest stay, at most so many.

    What was kept is kept again, so a batch that is sent twice changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        before = read()
        entries = batch if before is None else before.unionByName(batch).dropDuplicates(["event_id"])
        write(reading.newest(reading.push_history(entries), "at", most))

    return take
