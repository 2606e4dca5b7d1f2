"""Stores, cleaning up, schedules, streamed history, searches of many queries, and pages that meet books."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillflow.operators import dedupe, fetching, reading, search, storage
from quillflow.sources import shared, store
from quillflow.streaming import reading as streams


@pytest.fixture
def files(spark, tmp_path):
    return store.FileStorage(spark, f"file://{tmp_path}")


def test_store(files):
    assert files.read("a/b.txt") is None and not files.exists("a") and files.files() == []
    files.write("a/b.txt", b"one")
    files.write("a/b.txt", "zwölf".encode())
    assert files.read("a/b.txt").decode() == "zwölf" and files.read("a/b.txt.bak") == b"one"
    assert files.files("a") == [("a/b.txt", 6), ("a/b.txt.bak", 3)] and store.size(files, "a") == 9
    place = store.to_trash(files, "a/b.txt", 0)
    assert place.startswith(".trash/") and files.read(place) and not files.exists("a/b.txt")
    assert files.remove("a") and not files.remove("a")
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(store.BadPath):
            files.write(bad, b"")
    with pytest.raises(store.BadPath):
        files.remove("")


def test_json_documents(files):
    assert store.read_json(files, "x.json", {}) == {}
    store.write_json(files, "x.json", {"title": "书"})
    store.write_json(files, "x.json", {"title": "新"})
    assert store.read_json(files, "x.json") == {"title": "新"}
    files._fs.delete(files._path("x.json"), False)
    stream = files._fs.create(files._path("x.json"))
    stream.write(bytearray(b'{"title": '))
    stream.close()
    assert store.read_json(files, "x.json") == {"title": "书"}
    assert store.new_id("b").startswith("b_") and len(store.new_id()) == 15 and len(store.timestamp_name(0)) == 15


def test_clearing_frees_what_it_tells(spark, files):
    for path in ("books/1/book.json", "books/1/toc-snapshot.json", "index/1.json", ".trash/2/x", ".staging/u.bin"):
        files.write(path, b"12345")
    listed = spark.createDataFrame(files.files(), "path string, bytes long")
    assert sorted(storage.clear(files, listed, ["trash", "staging", "snapshots"])) == [("snapshots", 1, 5), ("staging", 1, 5), ("trash", 1, 5)]
    assert [p for p, _ in files.files()] == ["books/1/book.json", "index/1.json"]
    with pytest.raises(ValueError, match="no target"):
        storage.clear(files, listed, ["books"])
    assert storage.clear(files, listed.limit(0), ["trash"]) == []


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    before = shared.made(spark)
    df = shared.settled(spark.range(3), "t")
    (path,) = (p for p in shared.made(spark) if p not in before)
    assert df.count() == 3 and path.startswith(shared.shared_dir(spark)) and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()

    shared.remove(spark, [path])
    assert shared.made(spark) == before

    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://x:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)


def test_many_queries(spark):
    texts = [(1, "ab " * 300), (2, "The  quick\nbrown fox"), (3, None), (4, ""), (5, "xaby aab"), (6, "aaaa")]
    queries = [(1, "ab"), (2, "quick brown"), (3, "THE quick brown fox"), (4, ""), (5, None), (6, "quick"), (7, "aa"), (8, "b a"), (9, "nowhere"), (10, "uick brown fo")]
    got = {(r.text_id, r.query_id): r.n_hits for r in search.search_many(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(queries, "query_id long, q string")).collect()}
    flat = {i: " ".join((t or "").lower().split()) for i, t in texts}
    want = {(i, k): t.count(q) for i, t in flat.items() for k, q in ((k, " ".join((q or "").lower().split())) for k, q in queries) if q and q in t}
    assert got == want and got[1, 1] == 300


def test_history_without_a_time(spark):
    rows = [("1", 1, 0, None, 1), ("1", 1, 10, None, 2), ("1", 1, 0, datetime(2024, 1, 1), 3), ("1", 1, 100, datetime(2024, 1, 2), 4), ("2", 1, 0, None, 5)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, char_offset int, at timestamp, event_id int")
    assert sorted(r.event_id for r in reading.push_history(df).collect()) == [1, 3, 4, 5]


def test_streamed_history(spark):
    schema = "book_id string, chapter_index int, char_offset int, at timestamp, event_id int"
    rng = random.Random(4)
    rows = [("1", rng.randint(1, 2), rng.randrange(200), datetime(2024, 1, 1, i // 60, i % 60), i) for i in range(90)]
    held = []
    take = streams.history_sink(lambda: spark.createDataFrame(held, schema) if held else None, lambda df: held.__setitem__(slice(None), [tuple(r) for r in df.collect()]), most=1000)
    for at in range(0, 90, 30):
        take(spark.createDataFrame(rows[at : at + 30], schema), at)
        take(spark.createDataFrame(rows[at : at + 30], schema), at)  # sent again
    whole = reading.push_history(spark.createDataFrame(rows, schema))
    assert sorted(r[4] for r in held) == sorted(r.event_id for r in whole.collect())


def test_schedules(spark):
    rows = [("a.com", 0, 1, 9000), ("a.com", 0, 2, 100), ("a.com", 0, 3, 100), ("a.com", 0, 4, 100), ("localhost:80", 0, 5, 500), ("localhost:80", 0, 6, 500)]
    got = {r.request_id: r.start_ms for r in fetching.scheduled(spark.createDataFrame(rows, "host string, at_ms long, request_id int, duration_ms long")).collect()}
    assert got == {1: 0, 2: 3000, 3: 6000, 4: 9000, 5: 0, 6: 30}
    slow = [("b.com", 0, n, 20_000) for n in range(4)]
    got = sorted(r.start_ms for r in fetching.scheduled(spark.createDataFrame(slow, "host string, at_ms long, request_id int, duration_ms long")).collect())
    assert got == [0, 3000, 20_000, 23_000]


def test_workable_links(spark):
    tasks = spark.createDataFrame([("t", fetching.RUNNING), ("u", fetching.RUNNING), ("v", fetching.DONE)], "task_id string, state string")
    commands = spark.createDataFrame([("u", "pause", 1, 1), ("v", "cancel", 1, 2)], "task_id string, command string, at int, command_id int")
    after = fetching.commanded(tasks, commands)
    assert {r.task_id: r.state for r in after.collect()} == {"t": "running", "u": "paused", "v": "done"}
    links = spark.createDataFrame([(t, t, i) for t in "tuv" for i in (1, 2)], "task_id string, book_id string, index int")
    done = spark.createDataFrame([("t", 1, True)], "book_id string, index int, is_ok boolean")
    assert [(r.task_id, r["index"]) for r in fetching.workable(links, after, done).collect()] == [("t", 2)]


def test_pages_meet_books_as_all_pairs_do(spark):
    rng = random.Random(7)
    title = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    books = [(str(n), title(), rng.choice(["x.com", "y.com"]), n % 5, n) for n in range(60)]
    pages = [(n, rng.choice(["x.com", "z.com", ""]), title(), None) for n in range(80)]
    got = {r.page_id: (r.via, r.book_id) for r in dedupe.resolve_pages(spark.createDataFrame(pages, "page_id long, host string, title string, book_id string"), spark.createDataFrame(books, "book_id string, title string, source_site string, total_chapters int, position int")).collect()}
    grams = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}

    def one(a, b):
        return bool(a and b) and (a == b or ((a in b or b in a) and min(len(a), len(b)) >= 2) or len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6)

    for i, host, t, _ in pages:
        met = [(0 if host and site == host else 1, n, k) for k, name, site, _, n in books if one(t, name)]
        best = min(met, default=None)
        assert got[i] == (("new", None) if best is None else (("same-site", "same-title")[best[0]], best[2]))


def test_groups_of_titles_in_chains(spark):
    """A chain of titles, each like the next only: seeds alternate, in rounds."""
    titles = ["".join(chr(0x4E00 + i + k) for k in range(9)) for i in range(12)]
    df = spark.createDataFrame([(str(i), t, "", 1, i) for i, t in enumerate(titles)], "book_id string, title string, author string, total_chapters int, position int")
    grams = [{t[k : k + 2] for k in range(8)} for t in titles]
    like = {(a, b) for a, b in itertools.combinations(range(12), 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.75}
    owner = {}
    for a in range(12):
        if a in owner:
            continue
        owner[a] = a
        owner |= {b: a for b in range(a + 1, 12) if b not in owner and (a, b) in like}
    got = {int(r.book_id): int(r.group_id) for r in dedupe.duplicate_groups(df).collect()}
    assert got == {b: a for b, a in owner.items() if sum(x == a for x in owner.values()) > 1} and len(set(got.values())) > 3
    assert dedupe.duplicate_groups(df.withColumn("title", F.lit(None).cast("string")).limit(3)).select("group_id").distinct().count() == 1
