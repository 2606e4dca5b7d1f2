"""Import: bytes or texts to checked, numbered chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions import encoding
from quillflow.functions.text import char_count, content_hash, trim, unix_newlines
from quillflow.functions.titles import MAX_LINE, heading_pattern, is_heading
from quillflow.operators import chapters as chapter_ops
from quillflow.operators import cleaning

WHOLE, PREFACE = "全文", "卷首"
SECTION = "array<struct<title:string,content:string,is_preface:boolean>>"


def sections(text: Column, pattern: str, max_line: int = MAX_LINE) -> Column:
    """The chapters of a text as an array of title, content and is_preface. A chapter's content begins with its heading.

    Without a heading the text is one chapter; text before the first heading is a preface. All within the row: no line is shuffled.
    """
    lines = F.split(unix_newlines(text), "\n")
    heads = F.filter(F.transform(lines, lambda line, i: F.when(is_heading(line, pattern, max_line), i)), lambda i: i.isNotNull())
    strip = lambda part: F.regexp_replace(F.array_join(part, "\n"), "^\n+|\n+$", "")
    section = lambda title, part, preface: F.struct(title.alias("title"), strip(part).alias("content"), F.lit(preface).alias("is_preface"))

    def divided(bounds: Column) -> Column:
        at, all_lines = bounds["heads"], bounds["lines"]
        before = F.slice(all_lines, 1, at[0])
        preface = F.when((at[0] > 0) & (trim(F.array_join(before, "\n")) != ""), F.array(section(F.lit(PREFACE), before, True))).otherwise(F.array().cast(SECTION))
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(all_lines)))
        parts = F.zip_with(at, ends, lambda a, b: section(trim(F.element_at(all_lines, a + 1)), F.slice(all_lines, a + 1, b - a), False))
        return F.concat(preface, parts)

    # through an array of one struct, so that lines and headings are found once
    once = F.transform(F.array(F.struct(heads.alias("heads"), lines.alias("lines"))), lambda x: F.when(F.size(x["heads"]) == 0, F.array(section(F.lit(WHOLE), x["lines"], False)).cast(SECTION)).otherwise(divided(x).cast(SECTION)))
    return once[0]


def chapterize(docs: DataFrame, rule: str = "default", pattern: str | None = None, ignore_case: bool = False, max_line: int = MAX_LINE) -> DataFrame:
    """A row a chapter: docs' columns but text, index, title, content, char_count, content_hash, is_preface."""
    found = sections(F.coalesce("text", F.lit("")), heading_pattern(rule, pattern, ignore_case), max_line)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, F.posexplode(found).alias("_i", "_s"))
    return rows.select(*rest, (F.col("_i") + 1).alias("index"), "_s.title", "_s.content", char_count("_s.content").alias("char_count"), content_hash("_s.content").alias("content_hash"), "_s.is_preface")


def preview(chapters: DataFrame, key: str, rows: int = 80, chars: int = 60) -> DataFrame:
    """The first chapters of each document, and how each begins."""
    return chapters.filter(F.col("index") <= rows).select(key, "index", "title", "char_count", F.left("content", F.lit(chars)).alias("beginning"))


def resolve_source(payloads: DataFrame, detected: str | None = None) -> DataFrame:
    """payloads (id, text, upload, data_base64, bytes, encoding; any may be null) to source, data, text, encoding, confident.

    A pasted text comes before an upload, base64 and plain bytes; an encoding that is named before one that is found. detected: a column to hold what was found of the bytes.
    """
    decoded = F.try_to_binary("data_base64", F.lit("base64"))
    data = F.coalesce("upload", decoded, "bytes")
    pasted = F.coalesce(F.col("text"), F.lit("")) != ""
    source = F.when(pasted, "text").when(F.col("upload").isNotNull(), "upload").when(decoded.isNotNull(), "base64").when(F.col("bytes").isNotNull(), "bytes").otherwise("none")
    rows = payloads.withColumns({"source": source, "data": F.when(~pasted, data)}).withColumn("d", encoding.detect(F.col("data")))
    named = F.col("encoding").isin(list(encoding.CODECS))
    rows = rows.withColumns({"confident": pasted | named | (F.col("d.confident") & F.col("data").isNotNull()), "encoding": F.when(pasted, "UTF-8").when(named, F.col("encoding")).otherwise(F.col("d.encoding"))})
    return rows.withColumn("text", F.when(pasted, F.col("text")).otherwise(encoding.decode(F.col("data"), F.col("encoding")))).withColumnsRenamed({"d": detected} if detected else {}).drop(*[] if detected else ["d"])


def gates(rows: DataFrame, allow_mojibake: bool = False) -> DataFrame:
    """rows (text, confident) with rejected: the first gate that a text fails (empty, encoding, mojibake), or null."""
    state = encoding.inspect(F.coalesce("text", F.lit("")))
    fatal = F.lit(False) if allow_mojibake else state["fatal"]
    reason = F.when(trim(F.coalesce("text", F.lit(""))) == "", "empty").when(~F.col("confident"), "encoding").when(fatal, "mojibake")
    return rows.withColumn("rejected", reason)


def import_texts(rows: DataFrame, rule: str = "default", pattern: str | None = None, **clean: bool) -> DataFrame:
    """Chapters of the rows (with text) that pass the gates, cleaned after they are divided. rows: confident and the columns to keep."""
    kept = gates(rows).filter("rejected is null").drop("rejected", "confident")
    chapters = chapterize(kept, rule, pattern)
    if not any(clean.values()):
        return chapters
    done = cleaning.clean(chapters, "content", **clean)
    out = done.withColumns({"content": F.col("cleaned"), "char_count": char_count("cleaned"), "content_hash": content_hash("cleaned")})
    return out.select(*chapters.columns)


def rechapterize(chapters: DataFrame, rule: str = "default", pattern: str | None = None) -> DataFrame:
    """Books' texts put together from their chapters and divided anew; a preview as long as nobody writes it."""
    return chapterize(chapter_ops.source_text(chapters), rule, pattern)
