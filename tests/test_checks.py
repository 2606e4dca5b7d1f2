"""Checks for updates as a stream: books and notices in one commit, each batch once."""

from datetime import datetime

import pytest

from quillflow.operators import schedule
from quillflow.sources.tables import BucketTable
from quillflow.streaming import checks
from quillflow.streaming import reading as streams

BOOK = "book_id string, title string, total_chapters int, new_chapters int, status string, check_mode string, last_checked_at timestamp, next_check_at timestamp, last_updated_at timestamp"
LINK = "book_id string, index int, title string, url string, checked_at timestamp"


def link(book, i, day=1, title=None):
    return (book, i, title or f"第{i}章 标题{i}", f"http://h.example/{book}/{i}", datetime(2024, 1, day, 12))


@pytest.fixture()
def table(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/library", buckets=4)
    books = [(b, f"Book {b}", 2, 0, "x", mode, None, None, None) for b, mode in (("a", "daily"), ("b", "weekly"), ("c", "manual"))]
    t.upsert(checks.library(spark.createDataFrame(books, BOOK)))
    return t


@pytest.fixture()
def chapters(spark):
    return spark.createDataFrame([(b, i, f"第{i}章 标题{i}") for b in "abc" for i in (1, 2)], "book_id string, index int, title string")


def state(table):
    rows = table.read().select("book_id", "book.new_chapters", "book.last_checked_at", "book.next_check_at", "book.last_updated_at", "notices").collect()
    return {r.book_id: r for r in rows}


def test_books_and_notices_change_together(spark, table, chapters):
    take = checks.update_sink(table, lambda: chapters)
    batch = spark.createDataFrame([link("a", i) for i in (1, 2, 3, 4)] + [link("b", 1), link("b", 2), link("z", 1)], LINK)
    take(batch, 0)
    take(batch, 0)  # sent again
    got = state(table)
    assert table.version() == 2 and set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.new_chapters, a.last_checked_at, a.next_check_at, a.last_updated_at) == (2, datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 12), datetime(2024, 1, 1, 12))
    assert [(n.type, n.message, n.read, n.new_chapters) for n in a.notices] == [("update", "《Book a》有 2 章新内容，点开这条可以去更新。", False, 2)]
    assert got["b"].new_chapters == 0 and got["b"].notices == [] and got["b"].next_check_at == datetime(2024, 1, 8, 12) and got["b"].last_updated_at is None
    assert got["c"].last_checked_at is None
    take(spark.createDataFrame([link("a", i, 3) for i in (1, 2, 3, 4, 5)], LINK), 1)
    (again,) = state(table)["a"].notices
    assert again.new_chapters == 3 and again.at == datetime(2024, 1, 3, 12)  # the newest of its type
    assert [r.book_id for r in checks.notices(table.read()).collect()] == ["a"]
    assert schedule.unread(checks.notices(table.read())).count() == 1


def test_recovery_after_a_failed_batch(spark, tmp_path, table, chapters):
    for n, rows in enumerate([[link("a", 3)], [link("b", 3), link("b", 4)]]):
        spark.createDataFrame(rows, LINK).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(LINK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    calls = []

    def failing():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the chapters cannot be read")
        return chapters

    q = streams.drain(stream, checks.update_sink(table, failing), f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="cannot be read"):
        q.awaitTermination(60)
    assert sum(len(r.notices) for r in state(table).values()) == 1
    q = streams.drain(stream, checks.update_sink(table, failing), f"{tmp_path}/checkpoint")
    q.awaitTermination(60)
    got = state(table)
    assert {b: r.new_chapters for b, r in got.items()} == {"a": 1, "b": 2, "c": 0} and table.version() == 3
    # a commit that succeeded, of a batch whose end the stream did not see, is not made again
    checks.update_sink(table, lambda: chapters)(spark.createDataFrame([link("c", 9)], LINK), 1)
    assert table.version() == 3 and state(table)["c"].notices == []
