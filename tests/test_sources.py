import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from quillflow import schemas
from quillflow.sources import library
from quillflow.streaming import reading as streams


def make_library(root):
    for book, good in (("b1", True), ("b2", False)):
        (root / "books" / book / "chapters").mkdir(parents=True)
        doc = json.dumps({"book_id": book, "title": f"书{book}", "total_chapters": 2, "read_chapters": "9", "tags": ["x", "x"], "chapters": [{"index": 1}]})
        (root / "books" / book / "book.json").write_text(doc if good else doc[:20], encoding="utf-8")
        (root / "books" / book / "book.json.bak").write_text(doc, encoding="utf-8")
        (root / "books" / book / "chapters" / "0001.txt").write_text("﻿第一章\n正文", encoding="utf-8")
        (root / "books" / book / "chapters" / "12345.txt").write_text("远", encoding="utf-8")
    (root / "books" / "b3").mkdir()
    (root / "books" / "b3" / "book.json").write_text(" ", encoding="utf-8")
    (root / ".trash").mkdir()
    (root / ".trash" / "gone.txt").write_text("x")
    (root / "reading").mkdir()
    (root / "reading" / "progress.json").write_text(json.dumps({"progress": {"b1": {"chapter_index": 2, "percent": 0.5, "updated_at": "2024-01-02T03:04:05Z"}, "b2": {"chapter_index": 0}}}))


def test_library_files(spark, tmp_path):
    make_library(tmp_path)
    root = str(tmp_path)
    files = {r.path for r in library.list_files(spark, root).collect()}
    assert "books/b1/book.json" in files and not any(".trash" in f for f in files)
    status = {r.path: r.status for r in library.read_json(spark, f"{root}/books", "book.json", "book_id string").collect()}
    assert status == {"b1/book.json": "ok", "b2/book.json": "recovered", "b3/book.json": "corrupt"}
    books = {r.book_id: r for r in library.read_books(spark, root).collect()}
    assert books["b2"].title == "书b2" and books["b1"].read_chapters == 2 and books["b1"].tags == ["x"]
    chapters = {(r.book_id, r["index"]): r.content for r in library.read_chapters(spark, root).collect()}
    assert chapters[("b1", 1)] == "第一章\n正文" and chapters[("b2", 12345)] == "远"
    progress = {r.book_id: r for r in library.read_progress_map(spark, root).collect()}
    assert progress["b1"].updated_at == dt.datetime(2024, 1, 2, 3, 4, 5) and progress["b2"].chapter_index == 1


def test_backups_in_ranges(spark, tmp_path):
    """One large zip is many tasks' work, a damaged entry is told apart, and what is no zip is a row."""
    body = {f"data/books/b{i}/chapters/{i}.txt": f"chapter {i} " * (i % 50 + 1) for i in range(3000)}
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", "{}")
        z.writestr("data/", "")
        for name, text in body.items():
            z.writestr(name, text)
        at = z.getinfo("data/books/b7/chapters/7.txt").header_offset
    raw = bytearray((tmp_path / "large.zip").read_bytes())
    raw[at + 30 + len("data/books/b7/chapters/7.txt") + 2] ^= 0xFF
    (tmp_path / "large.zip").write_bytes(raw)
    (tmp_path / "broken.zip").write_bytes(b"PK\x05")
    assert library.backup_entries(spark, f"{tmp_path}/large.zip").count() == 3001
    rows = library.read_backups(spark, f"{tmp_path}/*.zip", 100_000)
    got = {r.path: r for r in rows.filter("backup like '%large%'").collect()}
    assert got["data/books/b7/chapters/7.txt"].content is None and got["data/books/b7/chapters/7.txt"].problem
    assert {k: r.content.decode() for k, r in got.items() if k in body and r.content is not None} == {k: v for k, v in body.items() if "/b7/" not in k}
    assert [r.path for r in rows.filter("backup like '%broken%'").collect()] == [None]
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_backups(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("backup/manifest.json", "{}")
        z.writestr("backup/data/library.json", '{"books": []}')
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("other.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    rows = library.read_backups(spark, f"{tmp_path}/*.zip").collect()
    assert sorted(r.path for r in rows if r.path) == ["data/library.json", "manifest.json"]
    assert sum(r.problem is not None for r in rows) == 2


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "book_id string, n int")
    library.write_version(df, str(tmp_path), "books")
    library.write_version(df.withColumn("n", F.lit(2)), str(tmp_path), "books")
    assert library.read_version(spark, str(tmp_path), "books").first().n == 2
    assert library.read_version(spark, str(tmp_path), "books", back=1).first().n == 1


def stream(spark, path, schema, batches):
    """Batches of rows, one file each, as a stream that takes a file at a time."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def run(spark, query):
    query.awaitTermination(120)
    assert query.exception() is None


def at(day, minute=0):
    return dt.datetime(2024, 1, day, 10, minute)


def test_streams_of_sessions(spark, tmp_path):
    rows = [[("a", at(1), 5), ("a", at(1, 20), 7)], [("b", at(2), 11), ("a", at(1, 25), 1)]]
    s = stream(spark, tmp_path, "book_id string, started_at timestamp, duration_ms long", rows)
    got = []
    run(spark, streams.drain(streams.by_window(s), lambda df, _: got.append([(r.since.day, r.ms) for r in df.collect()]), f"{tmp_path}/c1", "complete"))
    assert sorted(got[-1]) == [(1, 13), (2, 11)]
    last = []
    sat = streams.sittings(s)
    run(spark, streams.drain(sat, lambda df, _: last.append([(r.book_id, r.ms, r.n_sessions) for r in df.collect()]), f"{tmp_path}/c2", "complete"))
    assert sorted(last[-1]) == [("a", 13, 3), ("b", 11, 1)]


def test_streams_of_positions(spark, tmp_path):
    rows = [[("a", 1, at(1)), ("a", 2, at(3))], [("a", 3, at(2)), ("b", 1, at(1))]]
    s = stream(spark, tmp_path, "book_id string, chapter_index int, updated_at timestamp", rows)
    got = []
    run(spark, streams.drain(streams.latest_positions(s), lambda df, _: got.append({r.book_id: r.chapter_index for r in df.collect()}), f"{tmp_path}/c1", "complete"))
    assert got[-1] == {"a": 2, "b": 1}
    state = []
    sink = streams.positions_sink(lambda: spark.createDataFrame(state[-1], s.schema) if state else None, lambda df: state.append([tuple(r) for r in df.select(*s.columns).collect()]))
    run(spark, streams.drain(s, sink, f"{tmp_path}/c2"))
    assert {r[0]: r[1] for r in state[-1]} == {"a": 2, "b": 1}
    seen = []
    run(spark, streams.drain(streams.throttled(s), lambda df, _: seen.extend(df.collect()), f"{tmp_path}/c3", "update"))
    assert {(r.book_id, r.chapter_index) for r in seen} == {("a", 1), ("a", 2), ("a", 3), ("b", 1)} or len(seen) >= 2


def test_streams_of_notices_and_captures(spark, tmp_path):
    rows = [[("a", "update", at(1), "x")], [("a", "update", at(2), "y"), ("b", "update", at(1), "z")]]
    s = stream(spark, tmp_path, "book_id string, type string, at timestamp, id string", rows)
    state = []
    sink = streams.notices_sink(lambda: spark.createDataFrame(state[-1], s.schema) if state else None, lambda df: state.append([tuple(r) for r in df.select(*s.columns).collect()]))
    run(spark, streams.drain(s, sink, f"{tmp_path}/c1"))
    assert [r[3] for r in state[-1]] == ["y", "z"]
    run(spark, streams.drain(s, sink, f"{tmp_path}/c1"))  # goes on from the checkpoint: nothing new
    assert len(state) == 2
    caps = [[(1, "b", "第1章", "h1", at(1)), (2, "b", "第2章", "h2", at(1))], [(3, "b", "第1章", "h1", at(1, 5))]]
    q = stream(spark, tmp_path / "q", "capture_id int, book_id string, title string, content_hash string, captured_at timestamp", caps)
    empty = spark.createDataFrame([], schemas.CHAPTER)
    plans = []
    run(spark, streams.drain(streams.unrepeated(q), streams.captures_sink(lambda: empty, lambda df: plans.extend(df.collect())), f"{tmp_path}/c2"))
    assert sorted(r.capture_id for r in plans) == [1, 2] and {r.action for r in plans} == {"append"}
