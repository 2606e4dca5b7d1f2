import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillflow import schemas
from quillflow.functions import coerce, encoding, text, titles, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()[0]


def test_white_space_of_web_scripts(spark):
    assert one(spark, "　a﻿ \t b\n", text.collapse) == "a b"
    assert one(spark, " x　", text.trim) == "x"
    assert one(spark, " 一 二\n三　", text.char_count) == 3


def test_hash_and_ids(spark):
    assert one(spark, "a b\nc", text.content_hash) == one(spark, "abc", text.content_hash)
    assert one(spark, " 剑来 ", lambda c: text.book_id(F.lit("local"), c)) == "0a6a4acd6918"
    assert one(spark, 12345, text.chapter_file, "int") == "12345.txt"
    assert one(spark, 7, text.chapter_file, "int") == "0007.txt"
    assert one(spark, 'a/b:c?"', text.safe_name) == "a_b_c__"
    assert one(spark, "<a href='x'>&</a>", text.escape_html) == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"


def test_positions_do_not_overlap(spark):
    assert one(spark, "abcabcab", lambda c: text.positions(c, F.lit("ab"))) == [0, 3, 6]
    assert one(spark, "aaaa", lambda c: text.positions(c, F.lit("aa"))) == [0, 2]
    assert one(spark, "a.b.c", lambda c: text.positions(c, F.lit("."))) == [1, 3]
    assert one(spark, "aaaa", lambda c: text.positions(c, F.lit("a"), 3)) == [0, 1, 2]
    assert one(spark, "abc", lambda c: text.positions(c, F.lit("x"))) == []


def test_segments_and_sizes(spark):
    assert [s["label"] for s in one(spark, "x" * 1300, text.segments)] == ["开头", "中间", "结尾"]
    assert [s["label"] for s in one(spark, "x" * 1000, text.segments)] == ["开头", "结尾"]
    assert one(spark, 1536, text.format_bytes, "long") == "1.5 KB"
    assert one(spark, 1024**3, text.format_bytes, "long") == "1.0 GB"
    assert one(spark, 1024**3, lambda c: text.format_bytes(c, largest="MB"), "long") == "1,024.0 MB"
    assert one(spark, 1536, lambda c: text.format_bytes(c, largest="MB"), "long") == "1.5 KB"
    assert one(spark, 3_700_000, text.format_duration, "long") == "1 小时 1 分钟"
    assert one(spark, 59_000, text.format_duration, "long") == "59 秒"


def test_coercion(spark):
    assert one(spark, "", coerce.as_int) == 0
    assert one(spark, "x", lambda c: coerce.as_int(c, 5)) == 5
    assert one(spark, "-3.9", coerce.as_int) == -3
    assert one(spark, "-3", coerce.as_count) == 0
    assert one(spark, "NaN", coerce.as_ratio) == 0.0
    assert one(spark, "7", coerce.as_ratio) == 1.0
    assert one(spark, "FALSE", coerce.as_bool) is False
    assert one(spark, "yes", coerce.as_bool) is True
    assert one(spark, "no date", coerce.as_time) is None
    assert one(spark, [" a ", "", None, "b", "a"], coerce.as_strings, "array<string>") == ["a", "b"]
    assert one(spark, None, coerce.as_strings, "array<string>") == []


def test_chapter_numbers(spark):
    cases = {
        "第12章 开始": 12, "第 3 回": 3, "第十二章": 12, "第一百零五章": 105, "第二十三章": 23, "Chapter 42": 42, "12. 标题": 12, "序章": None, "第１２章": 12,
        "第十二万章": 20010, "第零章": None, "第0章": 0, "第1百章": 100, "第三部": None, "chapter 9": 9, "没有": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", titles.chapter_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_skeleton_and_similarity(spark):
    assert one(spark, "《剑来》（精校版）", titles.skeleton) == "剑来"
    assert one(spark, "《剑来》（精校版）", lambda c: titles.skeleton(c, brackets=False)) == "剑来（精校版）"
    assert one(spark, "a", titles.bigrams) == ["a"]
    assert one(spark, "", titles.bigrams) == []
    assert one(spark, "abab", titles.bigrams) == ["ab", "ba"]
    same = one(spark, "诡秘之主", lambda c: titles.jaccard(titles.bigrams(c), titles.bigrams(c)))
    other = one(spark, "诡秘之主", lambda c: titles.jaccard(titles.bigrams(c), titles.bigrams(F.lit("全职高手"))))
    assert (same, other) == (1.0, 0.0)


def test_hosts(spark):
    cases = {"http://User@A.com:80/x": "a.com", "https://a.com:8443/": "a.com:8443", "http://a.com:443/": "a.com:443", "https://a.com:443": "a.com", "no url": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.host(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == cases
    rows = spark.createDataFrame([("http://a.com/b/c", "../d"), ("http://a.com/b/", "http://x.org/y"), (None, "z")], "b string, h string").select(urls.absolute(F.col("b"), F.col("h"))).collect()
    assert [r[0] for r in rows] == ["http://a.com/d", "http://x.org/y", None]


SAMPLE = "第一章 开始\n他说：我们来到这个地方，已经有很多年了。天上的云，地上的人，都在变化之中。\n" * 4


def test_encodings_round_trip(spark):
    for name in ("gbk", "gb18030", "big5", "utf-16-le", "utf-16-be", "utf-8", "utf-8-sig"):
        found = encoding.detect_one((SAMPLE if name != "big5" else "我們來到這個地方，已經有很多年了。天上的雲，地上的人，都在變化之中。" * 4).encode(name))
        wanted = {"gbk": {"GBK"}, "gb18030": {"GBK"}, "big5": {"BIG5"}, "utf-16-le": {"UTF-16LE"}, "utf-16-be": {"UTF-16BE"}, "utf-8": {"UTF-8"}, "utf-8-sig": {"UTF-8 BOM"}}[name]
        assert found[0] in wanted and found[2], (name, found)
    noise = bytes((i * 37) % 251 for i in range(512))
    assert not encoding.detect_one(noise)[2]
    assert encoding.detect_one(b"") == ("UTF-8", 0.0, False, [])
    row = spark.createDataFrame([(SAMPLE.encode("utf-16-le"),)], "b binary").select(encoding.detect(F.col("b")).alias("d"), encoding.zero_parity(F.col("b")).alias("p"), encoding.decode(F.col("b"), F.lit("UTF-16LE")).alias("t")).first()
    assert row.d.encoding == "UTF-16LE" and row.t == SAMPLE
    assert one(spark, "plain ascii text, long enough".encode("utf-16-be"), encoding.zero_parity, "binary") == "UTF-16BE"


def test_mojibake(spark):
    broken = SAMPLE.encode("utf-8").decode("latin-1")
    got = one(spark, broken, encoding.recover)
    assert got.applied and got.text == SAMPLE and got.chain == "latin1→utf8"
    lost = one(spark, "锟斤拷锟斤拷", encoding.inspect)
    assert lost.fatal and lost.mojibake
    lossy = SAMPLE.encode("gbk").decode("utf-8", "replace")
    assert one(spark, lossy, encoding.recover).unrecoverable
    fine = one(spark, SAMPLE, encoding.inspect)
    assert not fine.mojibake and not fine.fatal
    assert not one(spark, None, encoding.recover).applied


def test_scores_agree_with_and_without_python(spark):
    s = one(spark, SAMPLE, encoding.text_scores)
    mine = encoding.score(SAMPLE)
    assert abs(s.score - mine.total) < 1e-9 and abs(s.familiar_ratio - mine.familiar) < 1e-9 and mine.familiar > 0.2
    assert one(spark, "", encoding.text_scores).score == -50


def test_books_are_normalised_and_validated(spark):
    raw = spark.createDataFrame([(" b1 ", "T", "12", "40", "x", [" a ", "a", ""]), ("bad id!", "", None, "-3", "在读", None)], "book_id string, title string, total_chapters string, read_chapters string, status string, tags array<string>")
    rows = schemas.normalize_book(raw, F.lit("2024-01-01").cast("timestamp")).withColumn("problems", schemas.book_problems()).collect()
    assert (rows[0].book_id, rows[0].read_chapters, rows[0].status, rows[0].tags, rows[0].problems) == ("b1", 12, "未读", ["a"], [])
    assert rows[0].source_site == "local" and rows[0].check_mode == "manual" and rows[0].schemaVersion == 1
    assert rows[1].problems == ["book_id malformed", "title missing"] and rows[1].read_chapters == 0


def test_chapters_and_others_are_normalised(spark):
    c = schemas.normalize_chapter(spark.createDataFrame([("b", 3, None, " x y "), ("b", 0, None, None)], "book_id string, index int, title string, content string")).collect()
    assert (c[0].title, c[0].char_count) == ("第 3 章", 2) and c[1].title == "未命名章节"
    p = schemas.normalize_progress(spark.createDataFrame([("b", "0", "7.5")], "book_id string, chapter_index string, chapter_ratio string")).first()
    assert (p.chapter_index, p.chapter_ratio) == (1, 1.0)
    s = schemas.normalize_session(spark.createDataFrame([("b", "2024-01-02 10:00:00", "-5")], "book_id string, started_at string, duration_ms string")).first()
    assert (s.day, s.duration_ms) == ("2024-01-02", 0)
    m = schemas.normalize_mark(spark.createDataFrame([("m", "b")], "id string, book_id string")).first()
    assert m.chapter_index == 1 and m.selected_text == ""


def test_migrations(spark):
    import pytest

    df = spark.createDataFrame([(1,)], "a int")
    steps = [(1, 2, lambda d: d.withColumn("b", F.lit(2))), (2, 3, lambda d: d.withColumn("c", F.lit(3)))]
    assert schemas.migrate(df, 1, steps, 3).columns == ["a", "b", "c"]
    with pytest.raises(schemas.MigrationError):
        schemas.migrate(df, 4, steps, 3)
    with pytest.raises(schemas.MigrationError):
        schemas.migrate(df, 0, steps, 3)


def test_second_opinion():
    body = "山间的风很凉，他握紧了手里的剑。这里有一段中文，用来测试编码识别能不能正常工作。"
    old = "第一章　山間的風很涼，他握緊了手裡的劍，這裡用繁體字考驗 BIG5。"
    assert encoding.vote(body.encode("gbk"))[0] == "GBK" and encoding.vote(body.encode("gbk"))[1] > 0.9
    assert encoding.vote(old.encode("big5"))[0] == "BIG5" and encoding.vote(old.encode("big5"))[1] > 0.7
    assert encoding.vote(body.encode()) == ("UTF-8", 1.0)
    # a text of UTF-8 with a broken character in it is no valid UTF-8, and still put together like it
    cut = (body * 5).encode()[:-1]
    assert encoding.vote(cut)[0] == "UTF-8" and encoding.detect_one(cut)[0] == "UTF-8"
    noise = bytes((i * 37) % 251 for i in range(512))
    assert all(encoding.vote(x) is None for x in (noise, b"", None, b"plain", "é".encode("latin-1")))
    # short texts of the import tests: found, and surely
    name, sure, confident, _ = encoding.detect_one(body.encode("gbk"))
    assert (name, confident) == ("GBK", True) and sure >= 0.75
    assert encoding.detect_one(old.encode("big5"))[0] == "BIG5" and encoding.detect_one(noise)[2] is False
    assert encoding.detect_one(body.encode("utf-16-le"))[0] == "UTF-16LE"


def test_familiar_characters_are_learned(spark):
    df = spark.createDataFrame([("的的的一一 a",), ("一的是",), (None,), ("",)], "text string")
    assert [(r.char, r.n) for r in encoding.familiar_of(df, most=2).collect()] == [("的", 4), ("一", 3)]
    learned = "".join(r.char for r in encoding.familiar_of(df).collect())
    assert encoding.score("的一是", learned).familiar == 1.0 and encoding.score("山水", learned).familiar == 0.0


@pytest.mark.parametrize("of", [encoding.recover, lambda c: encoding.decode(F.encode(c, "UTF-8"), F.lit("UTF-8"))])
def test_long_texts_go_to_python_in_small_batches(spark, of):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(1).select(of(F.lit("x")))

    @F.pandas_udf("long")
    def rows(batch: pd.Series) -> pd.Series:
        return pd.Series([len(batch)] * len(batch))

    # 50 MB that were one batch
    most = spark.range(0, 10_000, 1, 1).select(rows(F.repeat(F.lit("ab"), 2500)).alias("n")).agg(F.max("n")).first()[0]
    assert most * 5000 <= 2 * encoding.BATCH_BYTES


def test_decoding_utf8_in_the_jvm_is_python_s(spark):
    cases = [b"", b"plain", "é漢😀".encode(), b"\xef\xbb\xbfx", b"\xef\xbb\xbf\xef\xbb\xbfx", b"a\xffb", b"\xed\xa0\x80", b"\x00", None]
    got = spark.createDataFrame(list(enumerate(cases)), "n int, data binary").select("n", encoding.decode(F.col("data"), F.lit("UTF-8")).alias("t"), encoding.decode(F.col("data"), F.lit(None).cast("string")).alias("u")).collect()
    assert {r.n: r.t for r in got} == {n: None if x is None else x.decode("utf-8", "replace").removeprefix("\ufeff") for n, x in enumerate(cases)}
    assert all(r.u is None for r in got)
