"""Tables of several writers, and the kept search index."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from quillflow.operators import search
from quillflow.sources.search_index import KeptIndex
from quillflow.sources.tables import BucketTable, Conflict

SCHEMA = "book_id string, title string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(table, **how):
    return sorted(tuple(r) for r in table.read(**how).collect())


def test_changes_make_versions(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", buckets=4)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.upsert(rows(spark, ("a", "A", 1), ("b", "B", 2), ("c", None, 3))) == 1
    assert t.upsert(rows(spark, ("b", "B2", 5), ("d", "D", 4))) == 2
    assert t.patch(rows(spark, ("a", None, 9), ("z", "Z", 0))) == 3
    assert t.remove(rows(spark, ("c", None, None))) == 4
    assert content(t) == [("a", "A", 9), ("b", "B2", 5), ("d", "D", 4)]
    assert content(t, version=1) == [("a", "A", 1), ("b", "B", 2), ("c", None, 3)]
    assert t.remove(rows(spark, ("a", "", 0), ("b", "", 0), ("d", "", 0))) == 5 and content(t) == []
    assert t.upsert(rows(spark, ("e", "E", 1))) == 6 and content(t) == [("e", "E", 1)]


def test_buckets_that_are_not_touched_stay(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", buckets=8)
    t.upsert(rows(spark, *((str(i), "x", i) for i in range(100))))
    before = t.manifest().buckets
    t.upsert(rows(spark, ("5", "y", 5)))
    after = t.manifest().buckets
    assert sum(before[b] != after[b] for b in before) == 1 and t.read().count() == 100
    mine = t.buckets_of(rows(spark, ("5", "", 0)))
    assert len(t.read(buckets=mine).inputFiles()) == 1 and ("5", "y", 5) in content(t, buckets=mine)


def test_a_writer_that_comes_too_late_takes_its_change_up_again(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", buckets=1)
    t.upsert(rows(spark, ("a", "A", 1)))
    seen = []

    def slow(old, version):
        seen.append(version)
        if len(seen) == 1:
            BucketTable(spark, f"{tmp_path}/t", buckets=1).patch(rows(spark, ("a", None, 10)))  # another writer, before the first one commits
        return old.withColumn("n", F.col("n") + 1)

    assert t.change([0], slow) == 3 and seen == [2, 3]
    assert content(t) == [("a", "A", 11)]
    with pytest.raises(Conflict):
        t.change([0], lambda old, v: (BucketTable(spark, f"{tmp_path}/t", buckets=1).patch(rows(spark, ("a", "B", v))), old)[1], tries=3)


def test_a_writer_of_other_buckets_computes_once(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", buckets=16)
    t.upsert(rows(spark, *((str(i), "x", 0) for i in range(60))))
    one = t.buckets_of(rows(spark, ("1", "", 0)))
    other = next(str(i) for i in range(60) if t.buckets_of(rows(spark, (str(i), "", 0))) != one)
    calls = []

    def slow(old, version):
        calls.append(version)
        if len(calls) == 1:
            t.upsert(rows(spark, (other, "other", 7)))
        return old.withColumn("n", F.lit(1))

    assert t.change(one, slow) == 3 and calls == [2]
    assert dict((r[0], r[1]) for r in content(t))[other] == "other" and {r[2] for r in content(t, buckets=one)} == {1}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    BucketTable(spark, f"{tmp_path}/t", buckets=2).upsert(rows(spark, ("a", "A", 0), ("b", "B", 0)))
    failed = []

    def add():
        try:
            t = BucketTable(spark, f"{tmp_path}/t", buckets=2)
            for _ in range(3):
                t.change([0, 1], lambda old, _: old.withColumn("n", F.col("n") + 1))
        except Exception as why:  # told to the test below
            failed.append(why)

    threads = [threading.Thread(target=add) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    t = BucketTable(spark, f"{tmp_path}/t", buckets=2)
    assert not failed and t.version() == 10 and content(t) == [("a", "A", 9), ("b", "B", 9)]
    # what lost writers left goes; what the last two versions name stays
    left = {n for n, _ in t.files.names("data")}
    gone = t.clean(keep=2, older_s=0)
    assert set(gone) < left and content(t) == [("a", "A", 9), ("b", "B", 9)] and len(t.files.names("manifests")) == 2 and not [n for n in os.listdir(f"{tmp_path}/t") if n.startswith(".new")]


def test_a_change_keeps_to_its_buckets(spark, tmp_path):
    t = BucketTable(spark, f"{tmp_path}/t", buckets=8)
    t.upsert(rows(spark, ("a", "A", 1)))
    with pytest.raises(ValueError):
        t.change(t.buckets_of(rows(spark, ("a", "", 0))), lambda old, _: old.unionByName(rows(spark, *((str(i), "", i) for i in range(20)))))


def chapters(spark, texts):
    return spark.createDataFrame([(b, i, f"t{i}", c, f"h{hash(c)}") for b, parts in texts.items() for i, c in enumerate(parts, 1)], "book_id string, index int, title string, content string, content_hash string")


def test_kept_index(spark, tmp_path):
    texts = {f"b{i}": [f"chapter one of book {i}  and\n more", f"Second {i} \t thing"] for i in range(40)}
    texts["b7"][0] = "the Zwieback quotation, Once only"
    k = KeptIndex(spark, f"{tmp_path}/i", 8)
    assert k.refresh(chapters(spark, texts)) == 1
    assert k.refresh(chapters(spark, texts)) == 1  # nothing changed, nothing written
    assert [tuple(r) for r in k.matches("zwieback  QUOT".replace("  ", " ")).select("book_id", "chapter_index").collect()] == [("b7", 1)]
    assert len(k.buckets("zwieback quot")) == 1 and len(k.texts.read(buckets=k.buckets("zwieback quot")).inputFiles()) == 1
    assert k.buckets("zyzzyva") == [] and k.matches("zyzzyva").count() == 0
    texts["b3"][1] = "wholly new text"
    del texts["b9"]
    texts["b4"].pop()
    before = k.texts.manifest().buckets
    assert k.refresh(chapters(spark, texts)) == 2
    assert 1 <= sum(k.texts.manifest().buckets.get(b) != p for b, p in before.items()) <= 3
    whole = search.index(chapters(spark, texts))
    kept = k.texts.read()
    assert sorted(tuple(r) for r in kept.drop("version").collect()) == sorted(tuple(r) for r in whole.collect())
    assert {r.book_id for r in kept.filter("version = 2").collect()} == {"b3", "b4"}
    for q in ("chapter one", "S", "5", "wholly new", "and more", "one of book 9 "):
        want = search.matches(whole, q).select("book_id", "chapter_index", "at").collect()
        assert sorted(map(str, k.matches(q).select("book_id", "chapter_index", "at").collect())) == sorted(map(str, want))


def test_an_empty_library(spark, tmp_path):
    k = KeptIndex(spark, f"{tmp_path}/i", 4)
    assert k.refresh(chapters(spark, {"b": ["x y z", None, ""]})) == 1
    assert k.refresh(chapters(spark, {"b": ["x y z"]}).filter("false")) == 2 and k.texts.read().count() == 0


def test_refreshing_an_index_looks_at_the_chapters_once_for_changes_and_once_for_texts(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(content):
        looked.add(1)
        return content

    def chapters(*texts):
        rows = spark.createDataFrame([(str(i), 1, "", t) for i, t in enumerate(texts)], "book_id string, index int, title string, content string")
        return rows.withColumn("content_hash", marked("content"))

    k = KeptIndex(spark, f"{tmp_path}/i", 4)
    k.refresh(chapters("aa b", "c😀d", "e"))
    assert looked.value <= 3
    k.refresh(chapters("aa b", "c😀f", "e"))
    assert looked.value <= 3 + 2 * 3
    assert [r.book_id for r in k.matches("😀F").collect()] == ["1"] and not k.matches("😀d").collect() and [r.book_id for r in k.candidates("c😀").collect()] == ["1"]
    assert not list((tmp_path / "i" / "changed").iterdir())
