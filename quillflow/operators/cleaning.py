"""Cleaning of texts: advertising lines, indents, runs of blank lines, half-width punctuation between Chinese characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions.text import WS, trim, unix_newlines

# What marks a line as advertising or navigation, and how it is called.
AD_LINES = [
    (r"(?i)^\s*(?:https?:\/\/|www\.|[a-z0-9-]+\.(?:com|net|cn|org|cc|info|xyz)(?:\/|\s|$))", "网址"),
    (r"(?:本站|请记住本站|记住本书|收藏本站|最新网址|无弹窗|全文阅读|手机阅读|手机版阅读|txt下载|免费下载|首发)", "站点推广语"),
    (r"(?:笔趣|顶点|飘天|新笔趣|笔趣阁|书趣阁|顶点小说|全本小说|爱阅|言情小说吧)", "站点名称"),
    (r"(?:书友群|读者群|QQ群|qq群|加群|微信公众号|扫码关注|关注公众号)", "加群/关注"),
    (r"(?:求收藏|求推荐票|求月票|求打赏|求订阅|投推荐票|求张月票|感谢打赏|谢谢打赏)", "求票求赏"),
    (r"^\s*[（(]?(?:本章未完|未完待续|待续|下一章|上一章)[)）…]*\s*$", "翻页提示"),
    (r"^\s*第?\s*\d+\s*[\/／]\s*\d+\s*页\s*$", "页码"),
    (r"^\s*(?:阅读|点击|请到|详见).{0,12}(?:链接|网址|网站)", "外链引导"),
]
# How a sentence ends, and from which lengths on lines are judged by it.
SENTENCE = "[。！？；][\"'）)]?$"
LONG_SENTENCE, LONG_LINE = 80, 60
# Half-width marks and their full-width forms.
MARKS = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；"}
#: Chinese characters, punctuation and full-width forms, without white space.
CJK = "[\\u3400-\\u9fff\\u3001-\\u303f\\uff00-\\uffef\\u200b-\\u2027\\u202a-\\u202e\\u2030-\\u205e\\u2060-\\u206f]"
REMOVALS = 200
#: What a line of advertising has at least: a Chinese character, or a piece of an address. One cheap look saves most lines the patterns above.
MAYBE_AD = "[\\u4e00-\\u9fff]|://|(?i:www\\.|\\.(?:com|net|cn|org|cc|info|xyz))"


def ad_label(line: Column) -> Column:
    """Why a line is taken for advertising; null for others. Long lines are so only by an address, and long sentences never."""
    bare = trim(line)
    long = F.length(bare) > LONG_LINE
    label = F.when(~line.rlike(MAYBE_AD) | (bare == "") | ((F.length(bare) > LONG_SENTENCE) & bare.rlike(SENTENCE)), F.lit(None).cast("string"))
    for n, (pattern, name) in enumerate(AD_LINES):
        label = label.when(bare.rlike(pattern) if n == 0 else ~long & bare.rlike(pattern), name)
    return label


def _between(mark: str) -> str:
    """A mark after Chinese and before Chinese or the end, or after a letter or digit and before Chinese, white space aside; group 1 is what stands before."""
    at = f"\\{mark}"
    return f"({CJK}{WS}*(?={at}{WS}*(?:{CJK}|\\z))|[0-9A-Za-z]{WS}*(?={at}{WS}*{CJK})){at}"


def punctuation_changes(text: Column) -> Column:
    """How many marks unify_punctuation converts; a change of dots to an ellipsis counts once."""
    marks = F.when(text.rlike(CJK), sum((F.regexp_count(text, F.lit(_between(m))) for m in MARKS), F.lit(0))).otherwise(0)
    converted = _converted(text)
    return marks + F.when(_ellipses(converted) != converted, 1).otherwise(0)


def _converted(text: Column) -> Column:
    out = text
    for half, full in MARKS.items():
        out = F.regexp_replace(out, _between(half), f"$1{full}")
    return F.when(text.rlike(CJK), out).otherwise(text)


def _ellipses(text: Column) -> Column:
    for run, has in ((r"\.{3,}", "..."), ("。{2,}", "。。"), ("…{3,}", "………")):
        text = F.when(F.contains(text, F.lit(has)), F.regexp_replace(text, run, "……")).otherwise(text)
    return text


def unify_punctuation(text: Column) -> Column:
    return _ellipses(_converted(text))


def clean(df: DataFrame, text: str = "text", ad_lines: bool = False, indent: bool = False, blank_lines: bool = False, punctuation: bool = False) -> DataFrame:
    """df with cleaned (the text), removals (up to 200 of the lines taken out, as reason and line), n_ad_lines (all of them), n_marks and n_changed (characters).

    All switches are off unless set, and take effect in this order. No shuffle: a text is cleaned where it lies.
    """
    source = unix_newlines(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_source", source)
    work = F.col("_source")
    none = F.array().cast("array<struct<reason:string,line:string>>")
    if ad_lines:
        labelled = F.transform(F.split(work, "\n"), lambda line: F.struct(ad_label(line).alias("reason"), line.alias("line")))
        df = df.withColumn("_lines", labelled)
        df = df.withColumn("_ads", F.filter("_lines", lambda x: x["reason"].isNotNull()))
        work = F.array_join(F.transform(F.filter("_lines", lambda x: x["reason"].isNull()), lambda x: x["line"]), "\n")
    else:
        df = df.withColumn("_ads", none)
    if indent:
        work = F.regexp_replace(work, "(?m)^[ \\t\\u3000]+", "")
    if blank_lines:
        work = F.regexp_replace(work, "\n{3,}", "\n\n")
    df = df.withColumn("_work", work)
    work = F.col("_work")
    marks = punctuation_changes(work) if punctuation else F.lit(0)
    df = df.withColumns({"cleaned": unify_punctuation(work) if punctuation else work, "n_marks": marks})
    return df.withColumns({
        "n_ad_lines": F.size("_ads"), "removals": F.slice("_ads", 1, REMOVALS), "n_changed": F.abs(F.length("_source") - F.length("cleaned")) + F.col("n_marks"),
    }).drop("_source", "_lines", "_ads", "_work")
