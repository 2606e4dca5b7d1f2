import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillflow.functions.html import parsed
from quillflow.functions.titles import BadPattern
from quillflow.operators import chapters, cleaning, dedupe, fetching, importing, merge, pages, reading, schedule, search, shelf, storage
from quillflow.plans import text_queries


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


# Import -------------------------------------------------------------------------------------------------------------------------------------

BOOK = "简介文字\n第一章 起点\n正文提到第二章的事，很长的一句话。\n第二章 再来\n内容\nChapter 3 Three\n三\n番外\n外\n尾声\n完\n"


def sections(spark, text, **how):
    return importing.chapterize(spark.createDataFrame([(1, text)], "doc_id int, text string"), **how).orderBy("index").collect()


def test_chapterize(spark):
    rows = sections(spark, BOOK)
    assert [r.title for r in rows] == ["卷首", "第一章 起点", "第二章 再来", "Chapter 3 Three", "番外", "尾声"]
    assert rows[0].is_preface and rows[1].content.startswith("第一章 起点\n正文")
    assert [r.title for r in sections(spark, "没有标题\n的文本")] == ["全文"]
    assert [r.title for r in sections(spark, "a\r\n== x ==\r\nb\n== y ==\nc", pattern="^== .* ==$")] == ["卷首", "== x ==", "== y =="]
    assert [r.title for r in sections(spark, "# 标题\n正文\n## 二\n文", rule="markdown")] == ["# 标题", "## 二"]
    assert [r.title for r in sections(spark, "1. 标题\n正文\n002、二\n文", rule="with-number")] == ["1. 标题", "002、二"]
    assert [r.title for r in sections(spark, "第一章 他来了。\n正文")] == ["全文"]
    for empty in ("", None):
        assert [(r.title, r.content) for r in sections(spark, empty)] == [("全文", "")]
    with pytest.raises(BadPattern):
        sections(spark, "x", pattern="(")
    with pytest.raises(BadPattern):
        sections(spark, "x", rule="none")


def test_large_import(spark):
    text = "\n".join(f"第{i}章 标题{i}\n" + "很长的正文内容。" * 200 for i in range(1, 3001))
    assert len(text.encode()) > 8 << 20
    got = importing.chapterize(spark.createDataFrame([(1, text)], "doc_id int, text string")).agg(F.count("*"), F.max("index"), F.min("char_count")).first()
    assert (got[0], got[1]) == (3000, 3000) and got[2] > 1000


def test_sources_and_gates(spark):
    import base64

    rows = [(1, "pasted", None, None, None, None), (2, None, "上传内容".encode("gbk"), None, None, "GBK"), (3, None, None, base64.b64encode(b"hello").decode(), None, None), (4, None, None, None, None, None), (5, "锟斤拷", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, upload binary, data_base64 string, bytes binary, encoding string")
    out = {r.id: r for r in importing.gates(importing.resolve_source(df)).collect()}
    assert [out[i].source for i in range(1, 6)] == ["text", "upload", "base64", "none", "text"]
    assert out[2].text == "上传内容" and out[3].text == "hello"
    assert [out[i].rejected for i in range(1, 6)] == [None, None, None, "empty", "mojibake"]
    done = importing.import_texts(importing.resolve_source(df).select("id", "text", "confident"), ad_lines=True)
    assert done.count() == 3


# Cleaning -----------------------------------------------------------------------------------------------------------------------------------


def test_cleaning(spark):
    dirty = "　　第一段。\n\n\n\n请记住本站\nhttp://a.com/b\n你好,世界.3.14,很近\nHello, world 1,000\n等等..."
    df = spark.createDataFrame([(dirty,)], "text string")
    off = cleaning.clean(df).first()
    assert off.cleaned == dirty and off.n_changed == 0
    on = cleaning.clean(df, ad_lines=True, indent=True, blank_lines=True, punctuation=True).first()
    assert on.cleaned == "第一段。\n\n你好，世界.3.14，很近\nHello, world 1,000\n等等……"
    assert on.n_ad_lines == 2 and [r.reason for r in on.removals] == ["站点推广语", "网址"]
    labels = {"求月票": "求票求赏", "第 3 / 9 页": "页码", "（未完待续）": "翻页提示", "加入书友群": "加群/关注", "点击这里的链接": "外链引导", "": None, "普通的一行": None, "本站" + "长" * 70: None, "www." + "a" * 90: "网址"}
    rows = spark.createDataFrame([(k,) for k in labels], "l string").select("l", cleaning.ad_label(F.col("l")).alias("r")).collect()
    assert {r.l: r.r for r in rows} == labels
    assert cleaning.clean(spark.createDataFrame([(None,)], "text string"), ad_lines=True).first().cleaned == ""


def test_punctuation_rule_by_rule(spark):
    cases = {"汉,字": "汉，字", "汉 , 字": "汉 ， 字", "3.14,很接近": "3.14，很接近", "汉.": "汉。", "a,b": "a,b", "汉,b": "汉,b", "x:汉": "x：汉", "汉!汉?汉;": "汉！汉？汉；", "。。": "……", "………": "……"}
    rows = spark.createDataFrame([(k,) for k in cases], "l string").select("l", cleaning.unify_punctuation(F.col("l")).alias("r")).collect()
    assert {r.l: r.r for r in rows} == cases


# Chapters -----------------------------------------------------------------------------------------------------------------------------------


def chapter_rows(spark, *titles):
    rows = [("b", i, t, f"{i}-甲\n{i}-乙乙乙\n{i}-丙") for i, t in enumerate(titles, 1)]
    return chapters._with_text(spark.createDataFrame(rows, "book_id string, index int, title string, content string")).withColumns({"is_ok": F.lit(True), "fetched_at": F.lit(None).cast("timestamp"), "origin": F.lit("import")})


def test_diagnosis(spark):
    rows = [("b", 1, "第一章", 10, True, None), ("b", 2, "第三章", 0, False, None), ("b", 3, "第一章", 5, False, at(1)), ("b", 4, "番外", 5, False, None), ("b", 5, "第二章", 9, True, None)]
    df = spark.createDataFrame(rows, "book_id string, position int, title string, char_count int, is_ok boolean, fetched_at timestamp")
    got = {(r.chapter_index, r.type) for r in chapters.diagnose(df).collect()}
    assert got == {(2, "empty"), (2, "jump"), (3, "failed"), (3, "duplicate"), (3, "jump"), (4, "missing")}
    assert chapters.diagnosis(df).first().asDict() == {"book_id": "b", "total": 5, "empty": 1, "failed": 1, "missing": 1, "duplicate": 1, "jump": 2}


def test_edits_renumber(spark):
    c = chapter_rows(spark, "一", "二", "三", "四")
    places = lambda **k: spark.createDataFrame([("b", *k.values())], ", ".join(["book_id string", *(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in k.items())]))
    names = lambda df: [(r["index"], r.title) for r in df.orderBy("index").collect()]
    assert names(chapters.delete(c, places(at_index=2))) == [(1, "一"), (2, "三"), (3, "四")]
    assert names(chapters.rename(c, places(at_index=2, new_title=" 新 "))) == [(1, "一"), (2, "新"), (3, "三"), (4, "四")]
    halves = chapters.split(c, spark.createDataFrame([("b", 2, None, None)], "book_id string, at_index int, at_offset int, new_title string"))
    assert names(halves) == [(1, "一"), (2, "二"), (3, "二（下）"), (4, "三"), (5, "四")]
    parts = [r.content for r in halves.orderBy("index").collect()]
    assert parts[1] == "2-甲\n2-乙乙乙" and parts[2] == "2-丙"
    assert names(chapters.split(c, spark.createDataFrame([("b", 2, 999, None)], "book_id string, at_index int, at_offset int, new_title string")))[1:3] == [(2, "二"), (3, "三")]
    both = chapters.merge(c, spark.createDataFrame([("b", 2, 2, "")], "book_id string, at_index int, n int, new_title string"))
    assert names(both) == [(1, "一"), (2, "二 ～ 三"), (3, "四")]
    assert both.filter("index = 2").first().content.startswith("【二】\n\n2-甲")
    assert names(chapters.merge(c, spark.createDataFrame([("b", 4, 2, "")], "book_id string, at_index int, n int, new_title string"))) == names(c)


def test_diff_and_verify(spark):
    before = chapter_rows(spark, "一", "二", "三")
    now = chapter_rows(spark, "一", "改", "三", "四").withColumn("content_hash", F.when(F.col("index") == 3, "x").otherwise(F.col("content_hash"))).filter("index <> 1")
    got = {r["index"]: r.change for r in chapters.diff(now, chapters.snapshot(before, F.lit(at(1)))).collect()}
    assert got == {1: "removed", 2: "unchanged", 3: "revised", 4: "added"}
    v = chapters.verify(now, before).first()
    assert (v.n_expected, v.n_found, v.first_difference, v.ok) == (3, 3, 1, False)
    assert chapters.verify(before, before).first().ok


def test_exports(spark):
    c = chapter_rows(spark, "一", "二")
    books = spark.createDataFrame([("b", "书", "人", "local", "")], "book_id string, title string, author string, source_site string, intro string")
    text = chapters.export_text(books, c).first().text
    assert text.startswith("书\n作者：人\n来源：local") and "二\n\n2-甲" in text and "\n\n\n\n" not in text
    assert '"format":"book-export"' in chapters.export_json(books, c).first().json
    assert chapters.source_text(c).first().text.startswith("一\n\n1-甲")
    assert [(r.prev_index, r.next_index) for r in chapters.neighbours(c).orderBy("index").collect()] == [(None, 2), (1, None)]


# Search -------------------------------------------------------------------------------------------------------------------------------------


def test_search(spark):
    c = spark.createDataFrame([("a", 1, "t", "h", "Hello\nWorld hello"), ("a", 2, "t", "h", "none"), ("b", 1, "t", "h", "say HELLO world"), ("c", 1, "t", "h", None)], "book_id string, index int, title string, content_hash string, content string")
    ix = search.index(c)
    library = spark.createDataFrame([("b", "B", "x", 1), ("a", "A", "y", 2), ("c", "C", "z", 3)], "book_id string, title string, author string, position int")
    got = search.search(ix, library, " hello ")
    assert [(r.book_id, r.n_hits, r.n_chapters) for r in got.collect()] == [("b", 1, 1), ("a", 2, 1)]
    assert search.search_totals(got).first().asDict() == {"total_hits": 3, "matched_books": 2, "truncated": False}
    assert search.search(ix, library, "hello", limit=1).count() == 1
    assert [r.book_id for r in search.search(ix, library, "hello world", scope="book", book_id="a").collect()] == ["a"]
    s = search.snippets(search.matches(ix, "hello"), "hello").filter("book_id = 'b'").first()
    assert s.text == "say HELLO world" and s.offset_in_snippet == 4 and not s.prefix_trimmed
    for bad in (lambda: search.matches(ix, "  "), lambda: search.matches(ix, "x", scope="book")):
        with pytest.raises(search.SearchError):
            bad()
    states = {r.book_id: r.state for r in search.index_status(ix.filter("book_id <> 'b'"), library.filter("book_id <> 'c'")).collect()}
    assert states == {"a": "indexed", "b": "missing", "c": "stale"}
    many = search.search_many(spark.createDataFrame([(1, "x The quick  brown fox jumps"), (2, "brown quick")], "text_id int, text string"), spark.createDataFrame([(7, "the quick brown"), (8, "a b c")], "query_id int, q string"))
    assert [tuple(r) for r in many.collect()] == [(1, 7, 1)]


# Same books ---------------------------------------------------------------------------------------------------------------------------------


def brute_groups(books):
    import re

    def skeleton(t):
        t = re.sub(r"[（(\[【][^）)\]】]*[）)\]】]", "", t)
        return re.sub(r"[·・:：\-_—.,，。！!？?、'\"“”‘’《》<>\s]", "", t).lower()

    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set())
    used, out = set(), {}
    for i, (a, ta, wa, _) in enumerate(books):
        if a in used:
            continue
        group = [a]
        for b, tb, wb, _ in books[i + 1 :]:
            x, y = grams(skeleton(ta)), grams(skeleton(tb))
            alike = skeleton(ta) == skeleton(tb) or (x and y and len(x & y) / len(x | y) >= 0.75)
            if b not in used and alike and (not wa or not wb or wa == wb):
                group.append(b)
                used.add(b)
        if len(group) > 1:
            used.add(a)
            out |= {b: a for b in group}
    return out


def test_duplicate_groups(spark):
    import random

    rng = random.Random(5)
    words = ["诡秘之主", "诡秘之主上", "《诡秘之主》（全本）", "大道朝天录", "大道朝天", "!!", "??", "长夜余火集", "长夜余火"]
    books = [(f"b{i}", rng.choice(words), rng.choice(["", "甲", "乙"]), i % 7) for i in range(60)]
    df = spark.createDataFrame([(*b, n) for n, b in enumerate(books)], "book_id string, title string, author string, total_chapters int, position int")
    got = {r.book_id: r.group_id for r in dedupe.duplicate_groups(df).collect()}
    assert got == brute_groups(books)
    rows = {r.book_id: r for r in dedupe.duplicate_groups(df).collect()}
    chapters_of, at_ = {b[0]: b[3] for b in books}, {b[0]: n for n, b in enumerate(books)}
    for g in set(got.values()):
        members = [b for b in got if got[b] == g]
        assert {rows[b].keep for b in members} == {min(members, key=lambda b: (-chapters_of[b], at_[b]))}
    assert dedupe.duplicate_groups(df.limit(0)).count() == 0


def test_title_pairs_against_all(spark):
    import itertools
    import random

    rng = random.Random(9)
    titles = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    for t in (0.5, 0.75):
        want = {(a, b) for a, b in itertools.combinations(sorted(set(titles)), 2) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= t}
        assert {(r.skeleton_a, r.skeleton_b) for r in dedupe.title_pairs(df, t).collect()} == want


def test_captures(spark):
    books = spark.createDataFrame([("1", "剑来", "a.com", 5, 1), ("2", "诡秘之主", "b.com", 3, 2), ("3", "剑来", "b.com", 9, 3)], "book_id string, title string, source_site string, total_chapters int, position int")
    p = spark.createDataFrame([(1, "b.com", "《剑来》（精校版）", None), (2, "z.com", "剑来", None), (3, "z.com", "别的书", None), (4, "z.com", "x", "2"), (5, "z.com", "剑", None), (6, "", None, None)], "page_id int, host string, title string, book_id string")
    got = {r.page_id: (r.via, r.book_id, r.next_index) for r in dedupe.resolve_pages(p, books).collect()}
    assert got == {1: ("same-site", "3", 10), 2: ("same-title", "1", 6), 3: ("new", None, 1), 4: ("explicit", "2", 4), 5: ("new", None, 1), 6: ("new", None, 1)}
    c = chapter_rows(spark, "第1章", "第2章", "第3章").withColumn("is_ok", F.col("index") != 2)
    h = c.filter("index = 1").first().content_hash
    caps = spark.createDataFrame([(1, "b", "x", h), (2, "b", "第2章 补", "n1"), (3, "b", "第3章", "n2"), (4, "b", "第9章", "n3"), (5, "b", "", "n4"), (6, "z", None, "n5")], "capture_id int, book_id string, title string, content_hash string")
    got = {r.capture_id: (r.action, r.chapter_index) for r in dedupe.plan_captures(caps, c).collect()}
    assert got == {1: ("skip", 1), 2: ("fill", 2), 3: ("replace", 3), 4: ("append", 4), 5: ("append", 4), 6: ("append", 1)}


# Shelf and reading --------------------------------------------------------------------------------------------------------------------------


def test_positions_resolve(spark):
    books = spark.createDataFrame([("exact", 10), ("ratio", 10), ("percent", 5), ("fresh", 5), ("empty", 0), ("noffset", 10)], "book_id string, total_chapters int")
    rows = [("exact", 2, 30, 0.3, 0.1), ("ratio", 2, 500, 0.6, 0.1), ("percent", 9, 5, 0.5, 0.8), ("empty", 1, 1, 0.1, 0.1), ("noffset", 2, 0, 0.25, 0.1)]
    progress = spark.createDataFrame(rows, "book_id string, chapter_index int, char_offset int, chapter_ratio double, percent double")
    lengths = spark.createDataFrame([(b, 2, 100) for b, *_ in rows], "book_id string, index int, char_count int")
    got = {r.book_id: (r.mode, r.chapter_index, r.char_offset) for r in reading.resolve(books, progress, lengths).collect()}
    assert got == {"exact": ("exact", 2, 30), "ratio": ("by-ratio", 2, 60), "percent": ("by-percent", 4, 0), "fresh": ("fresh", 1, 0), "empty": ("empty", 1, 0), "noffset": ("by-ratio", 2, 25)}


def test_shelf(spark):
    schema = "book_id string, title string, author string, tags array<string>, source_site string, status string, total_chapters int, read_chapters int, new_chapters int, last_read_at timestamp, updatedAt timestamp, created_at timestamp"
    rows = [("a", "甲", "x", ["t"], "s", "在读", 10, 2, 0, at(2), at(1), at(1)), ("b", "Bee", "y", ["u"], "s", "已读完", 4, 4, 3, None, at(5), at(1)), ("c", "丙", "x", None, "r", "未读", 0, 0, 0, None, at(1), at(1))]
    books = spark.createDataFrame(rows, schema)
    progress = spark.createDataFrame([("a", 5, 10, 0.5, 0.1, at(3))], "book_id string, chapter_index int, char_offset int, chapter_ratio double, percent double, updated_at timestamp")
    d = shelf.decorate(books, progress)
    assert [(r.book_id, r.progress_percent, r.update_badge) for r in shelf.ordered(d).collect()] == [("b", 1.0, 3), ("a", 0.45, 0), ("c", 0.0, 0)]
    assert {r.pile: r.n_books for r in shelf.pile_counts(d).collect()} == {"在读": 1, "追更中": 1, "已读完": 1, "全部": 3}
    assert [r.book_id for r in shelf.filtered(books, q=" bEE").collect()] == ["b"]
    assert [r.book_id for r in shelf.filtered(books, status="在读", tag="t", site="s", author="x").collect()] == ["a"]
    card = shelf.continue_reading(d, spark.createDataFrame([("a", 5, "第五章")], "book_id string, index int, title string")).first()
    assert card.label == "第 5 章 · 第五章" and card.reader_url == "/reader.html?book=a&ch=5"
    assert {(r.facet, r.value) for r in shelf.facets(books).collect()} >= {("tag", "t"), ("site", "r"), ("author", "y")}
    assert shelf.library_stats(books).first().n_books == 3
    synced = {r.book_id: (r.read_chapters, r.status) for r in reading.sync_books(books, progress).collect()}
    assert synced == {"a": (5, "在读"), "b": (4, "已读完"), "c": (0, "未读")}


def test_sessions(spark):
    rows = [("a", at(15), 60_000, "2024-01-15"), ("a", at(17), 20_000, "2024-01-17"), ("b", at(14), 15_000, "2024-01-14")]
    s = spark.createDataFrame(rows, "book_id string, started_at timestamp, duration_ms long, day string")
    assert reading.totals(s).first().ms == 95_000
    assert reading.week_total(s, F.lit(at(17, 12))).first().ms == 80_000
    assert {(r.level, r.book_id): r.ms for r in reading.overview(s).collect() if r.level != "day"} == {("all", None): 95_000, ("book", "a"): 80_000, ("book", "b"): 15_000}
    assert reading.totals(reading.in_range(s, since="2024-01-15")).first().n_sessions == 2
    assert reading.totals(s.limit(0)).first().ms == 0


def test_bookmarks_and_history_against_loops(spark):
    import random

    rng = random.Random(3)
    marks = [(f"m{i:03}", rng.choice("ab"), 1, rng.randint(0, 12), rng.choice(["", "x"]), at(1, i // 60, i % 60)) for i in range(90)]
    df = spark.createDataFrame(marks, "id string, book_id string, chapter_index int, char_offset int, selected_text string, created_at timestamp")
    kept = []
    for m in marks:
        if not any(k[1:3] == m[1:3] and k[4] == m[4] and abs(k[3] - m[3]) <= 1 for k in kept):
            kept.append(m)
    assert sorted(r.id for r in reading.distinct_bookmarks(df).collect()) == sorted(k[0] for k in kept)
    entries = [(rng.choice("ab"), rng.randint(1, 2), rng.randint(0, 120), at(1 + i // 50, i % 24, i % 60, i % 60), i) for i in range(200)]
    entries.sort(key=lambda e: (e[3], e[4]))
    want, head = [], None
    for e in entries:
        if not head or head[:2] != e[:2] or abs(head[2] - e[2]) >= 40:
            want.append(e)
            head = e
    got = reading.push_history(spark.createDataFrame(entries, "book_id string, chapter_index int, char_offset int, at timestamp, event_id int"))
    assert sorted(r.event_id for r in got.collect()) == sorted(e[4] for e in want)


# Merging ------------------------------------------------------------------------------------------------------------------------------------


def test_merging(spark):
    schema = "book_id string, title string"
    local, remote = spark.createDataFrame([("1", "甲"), ("2", "乙")], schema), spark.createDataFrame([("2", "二"), ("3", "三")], schema)
    out = {m: sorted((r.title, r.outcome) for r in merge.merge_books(local, remote, m)[0].collect()) for m in merge.MODES}
    assert out["skip"] == sorted([("甲", "kept"), ("乙", "skipped"), ("三", "added")])
    assert out["overwrite"] == sorted([("甲", "kept"), ("二", "overwritten"), ("三", "added")])
    assert out["coexist"] == sorted([("甲", "kept"), ("乙", "kept"), ("二（导入）", "coexisted"), ("三", "added")])
    ids = merge.merge_books(local, remote, "coexist")[1]
    rows = merge.remapped(spark.createDataFrame([("2", 1), ("9", 1)], "book_id string, n int"), ids).collect()
    assert len(rows) == 1 and len(rows[0].book_id) == 12
    p = "book_id string, chapter_index int, updated_at timestamp"
    a, b = spark.createDataFrame([("1", 1, at(2)), ("2", 1, at(2))], p), spark.createDataFrame([("1", 9, at(2)), ("2", 9, at(3)), ("3", 9, at(1))], p)
    pick = lambda m: {r.book_id: r.chapter_index for r in merge.merge_progress(a, b, m).collect()}
    assert (pick("skip"), pick("overwrite"), pick("coexist")) == ({"1": 1, "2": 1, "3": 9}, {"1": 9, "2": 9, "3": 9}, {"1": 1, "2": 9, "3": 9})
    with pytest.raises(ValueError):
        merge.merge_progress(a, b, "other")
    s = spark.createDataFrame([("1", at(1), 5)], "book_id string, started_at timestamp, duration_ms int")
    assert merge.merge_sessions(s, s.union(s)).count() == 1 and merge.merge_sessions(s, s.withColumn("duration_ms", F.lit(6)).union(s)).count() == 2
    base = spark.createDataFrame([("1", "甲", 3, 5)], "book_id string, title string, total_chapters int, read_chapters int")
    new = spark.createDataFrame([("1", "新", 9, 1), ("2", "二", 2, 9)], base.schema)
    assert {r.book_id: (r.title, r.read_chapters) for r in merge.upsert(base, new).collect()} == {"1": ("新", 1), "2": ("二", 2)}
    with pytest.raises(ValueError):
        merge.create(base.withColumn("created_at", F.lit(0)), new.withColumn("created_at", F.lit(0)), "error")
    merged = merge.create(base.withColumn("created_at", F.lit(0)), new.withColumn("created_at", F.lit(1)), "merge")
    assert {r.book_id: (r.title, r.read_chapters, r.created_at) for r in merged.collect()} == {"1": ("甲", 1, 0), "2": ("二", 9, 1)}


# Updates, fetching, storage -----------------------------------------------------------------------------------------------------------------


def test_update_checks(spark):
    b = spark.createDataFrame([("1", "u", "daily", at(1), "未读", 0), ("2", "u", "weekly", at(9), "未读", 0), ("3", None, "daily", None, "未读", 0), ("4", "u", "manual", None, "未读", 0), ("5", "u", "daily", None, "未读", 0)], "book_id string, toc_url string, check_mode string, next_check_at timestamp, status string, new_chapters int")
    ids = lambda df: sorted(r.book_id for r in df.collect())
    now = F.lit(at(5))
    assert ids(schedule.due(b, now)) == ["1", "5"]
    assert ids(schedule.due(b, now, force=True)) == ["1", "2", "5"]
    assert ids(schedule.due(b, now, force=True, include_manual=True)) == ["1", "2", "4", "5"]
    have = spark.createDataFrame([("1", 1, "第一章"), ("1", 2, "第二章")], "book_id string, index int, title string")
    links = spark.createDataFrame([("1", 1, "第一章!", "a"), ("1", 2, "插入章", "b"), ("1", 3, "第三章", "c"), ("1", 4, "第三章 又", "c")], "book_id string, index int, title string, url string")
    assert [(r["index"], r.url) for r in schedule.new_links(links, have).collect()] == [(3, "c")]
    assert [(r["index"], r.title_before) for r in schedule.title_changes(links, have).collect()] == [(2, "第二章")]
    row = {r.book_id: r for r in schedule.checked(b, links, have, now).collect()}["1"]
    assert (row.new_chapters, row.status, row.next_check_at) == (1, "追更中", at(6))
    n = spark.createDataFrame([("1", "update", at(1), "x", False), ("1", "update", at(2), "y", False), ("2", "update", at(1), "z", False)], "book_id string, type string, at timestamp, id string, read boolean")
    assert [r.id for r in schedule.latest_notices(n, 200, "id").collect()] == ["y", "z"]
    assert schedule.mark_read(n, spark.createDataFrame([("x",)], "id string")).filter("read").count() == 1


def test_fetch_tasks(spark):
    r = spark.createDataFrame([("h", 0, 1), ("h", 10, 2), ("h", 9000, 3), ("g", 5, 4)], "host string, at_ms long, request_id int")
    started = fetching.paced(r)
    assert {x.request_id: x.start_ms for x in started.collect()} == {1: 0, 2: 3000, 3: 9000, 4: 5}
    assert {x.host: (x.requests, x.waits, x.wait_ms) for x in fetching.pacing_stats(started).collect()} == {"h": (3, 1, 2990), "g": (1, 0, 0)}
    t = spark.createDataFrame([(0, None, 2, 1, 9), (0, 50, 9, 0, 9)], "started_ms long, finished_ms long, done int, failed int, total int")
    assert [(x.elapsed_ms, x.eta_ms) for x in fetching.timing(t, F.lit(300)).collect()] == [(300, 600), (50, None)]
    assert [x[0] for x in spark.range(1, 5).select(fetching.retry_delay(F.col("id"))).collect()] == [800, 1600, 3200, None]


def test_pacing_beyond_the_numbers_of_an_int(spark):
    # 720 000 starts an interval apart take more milliseconds than an int holds
    many = spark.range(720_000).select(F.lit("h").alias("host"), F.lit(0).cast("long").alias("at_ms"), F.col("id").alias("request_id"))
    got = fetching.paced(many).agg(F.count("*"), F.max("start_ms"), F.max("wait_ms")).first()
    assert tuple(got) == (720_000, 719_999 * 3000, 719_999 * 3000)
    stats = fetching.pacing_stats(fetching.paced(many)).first()
    assert (stats.requests, stats.waits, stats.wait_ms) == (720_000, 719_999, 3000 * 719_999 * 720_000 // 2)


def test_import_gates_keeps_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "a text", "en"), (1, "", "en"), (None, " ", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_queries.import_gates(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "UTF-8", 0.98, True, None), (1, "UTF-8", 0.0, False, "empty"), (None, "UTF-8", 0.98, True, "empty")]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_storage(spark):
    f = spark.createDataFrame([("books/a/book.json", 10), ("books/a/chapters/0001.txt", 5), ("index/x.json", 7), (".trash/z", 3), ("library.json.bak", 2), ("settings.json", 4)], "path string, bytes long")
    got = {(r.section, r.owner): r.bytes for r in storage.usage(f).collect()}
    assert got[("books", "a")] == 15 and got[(None, None)] == 31 and got[("other", None)] == 6
    m = storage.backup_manifest(f).first()
    assert (m.n_files, m.bytes) == (3, 19)
    assert {r.target: r.bytes for r in storage.cleanup(f, ["trash", "rebuild-index"]).collect()} == {"trash": 3, "rebuild-index": 7}
    with pytest.raises(ValueError):
        storage.cleanup(f, ["all"])
    j = spark.createDataFrame([("a.json", "{}"), ("b.json", "{"), ("b.json.bak", "{}"), ("c.json", "")], "path string, text string")
    assert {r.file: r.status for r in storage.json_health(j).collect()} == {"a.json": "ok", "b.json": "recovered", "c.json": "corrupt"}


# Pages --------------------------------------------------------------------------------------------------------------------------------------

TOC = """<html><head><title>剑来_烽火戏诸侯_某站</title></head><body><div class="header"><a href="/">首页</a><a href="/a">分类</a><a href="/b">排行</a></div>
<div id="list"><ul>""" + "".join(f'<li><a href="/c/{i}.html">第{i}章 标题{i}</a></li>' for i in range(1, 13)) + """<li><a href="#top">第99章</a></li><li><a href="/c/1.html">第1章 标题1</a></li></ul></div></body></html>"""
PAGE = """<html><head><title>第一章_剑来</title></head><body><h1>第一章 开始</h1><div id="content"><p>第一段正文，写得足够长，好让它被认作正文内容，而不是导航。</p><p>求月票</p>第二段<br>第三段<a href="/next">下一章</a><script>x()</script></div>
<a href="/c/1_2.html">下一页</a></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://a.com/book/", TOC), (2, "http://a.com/c/1.html", PAGE), (3, "x", None), (4, "http://b.com/", "")], "page_id int, url string, html string")
    p = parsed(df, "page_id", "url").cache()
    best = pages.toc_candidates(p).filter("page_id = 1 and place = 1").first()
    assert best.selector.startswith("#list") and best.n_links == 13
    links = pages.page_links(p).filter("page_id = 1").orderBy("n").collect()
    assert len(links) == 15 and links[3].link == "http://a.com/c/1.html"
    got = {r.page_id: r for r in pages.extract(p).collect()}
    assert got[2].title == "第一章 开始" and got[2].n_removed == 1 and "求月票" not in got[2].content and "第二段\n第三段" in got[2].content
    assert got[2].next_href == "/c/1_2.html" and got[3].content == "" and got[4].content == ""
    toc = pages.toc_links(p).filter("page_id = 1").orderBy("index").collect()
    assert [(r["index"], r.title) for r in toc][:2] == [(1, "第1章 标题1"), (2, "第2章 标题2")] and len(toc) == 12
    meta = {r.page_id: r for r in pages.book_meta(p).collect()}
    assert (meta[1].title, meta[1].author, meta[1].site) == ("剑来", "烽火戏诸侯", "a.com") and meta[4].title == "b.com"


def test_walls_and_robots(spark):
    rows = [(1, "http://a.com/x", "请先登录后阅读", 200), (2, "http://a.com/x", "本章为付费章节", 200), (3, "http://a.com/deny/x", "ok", 200), (4, "ftp://a.com", "", 200), (5, "http://c.com/", "ok", None), (6, "http://c.com/", "ok", 404), (7, "http://c.com/最新章节", "正文", 200)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, status int")
    rules = spark.createDataFrame([("http://a.com", 200, "User-agent: *\nDisallow: /deny\nCrawl-delay: 5"), ("http://c.com", 404, "User-agent: *\nDisallow: /")], "origin string, status int, robots string")
    assert {r.page_id: r.reason for r in pages.inspect(df, rules).collect()} == {1: "login", 2: "paywall", 3: "robots", 4: "bad_url", 5: "network", 6: "http_error", 7: None}
    assert pages.robots(df, rules).filter("page_id = 1").first().crawl_delay == 5.0


def test_shelf_times_and_orders(spark):
    from quillflow.functions import dates

    now = F.lit(at(20, 12))
    cases = {at(20, 12): "刚刚", at(20, 11, 30): "30 分钟前", at(20, 3): "9 小时前", at(19, 23): "昨天", at(17): "3 天前", at(2): "2024-01-02"}
    rows = spark.createDataFrame([(k,) for k in cases], "t timestamp").select("t", dates.relative(F.col("t"), now).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    b = spark.createDataFrame([("1", "b", 5, 1), ("2", "A", 9, 3), ("3", "c", 1, 2)], "book_id string, title string, bytes int, total_chapters int")
    ids = lambda by: [r.book_id for r in storage.listed(b, by).collect()]
    assert (ids("bytes"), ids("chapters"), ids("title")) == (["2", "1", "3"], ["2", "3", "1"], ["2", "1", "3"])
    with pytest.raises(ValueError):
        storage.listed(b, "x")


def test_diagnosis_counts_issues_in_one_shuffle(spark):
    rows = [("a", i, f"Chapter {n}", size, True, None) for i, (n, size) in enumerate([(1, 5), (1, 0), (4, 5)])] + [("b", 0, "Chapter 1", 5, True, None)]
    df = spark.createDataFrame(rows, "book_id string, position int, title string, char_count int, is_ok boolean, fetched_at timestamp")
    got = chapters.diagnosis(df)
    assert {r.book_id: (r.total, r.empty, r.failed, r.missing, r.duplicate, r.jump) for r in got.collect()} == {"a": (3, 1, 0, 0, 1, 2), "b": (1, 0, 0, 0, 0, 0)}
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_resolving_pages_reads_each_once(spark):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(title):
        looked.add(1)
        return title

    raw = spark.createDataFrame([(1, "h", "Some long title"), (2, "g", "Another one")], "page_id int, host string, raw string")
    seen = raw.select("page_id", "host", F.lit(None).cast("string").alias("book_id"), read("raw").alias("title"))
    books = spark.createDataFrame([("b", "Some long title", "h", 3, 1)], "book_id string, title string, source_site string, total_chapters int, position int")
    got = {r.page_id: (r.via, r.book_id, r.next_index) for r in dedupe.resolve_pages(seen, books).collect()}
    assert got == {1: ("same-site", "b", 4), 2: ("new", None, 1)} and looked.value == 2
