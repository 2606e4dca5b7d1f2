"""Text as columns: white space, counts, hashes, ids, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web scripts define it: Java's \s has ASCII only, and with (?U) still lacks U+FEFF.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WS = f"[{SPACE}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"{WS}+", "")


def char_count(c: Column | str) -> Column:
    """Code points that are no white space."""
    return F.length(without_space(c))


def content_hash(c: Column | str) -> Column:
    """Equal for texts that differ in white space only."""
    return F.sha1(without_space(c))


def book_id(site: Column | str, title: Column | str) -> Column:
    return F.substring(F.sha1(F.concat(_col(site), F.lit("::"), trim(title))), 1, 12)


def chapter_file(index: Column | str) -> Column:
    """0001.txt; longer numbers stay whole."""
    number = _col(index).cast("string")
    return F.concat(F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0"), F.lit(".txt"))


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r'[\\/:*?"<>|]', "_")


def unix_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\r\n?", "\n")


def strip_bom(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "^﻿", "")


def escape_html(c: Column | str) -> Column:
    out = _col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def quoted(needle: str) -> str:
    """A pattern that matches the needle as it is."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def positions(text: Column, needle: Column, most: int = 200) -> Column:
    """Where needle begins in text (0 first), matches not overlapping, at most so many. Both lower-cased before."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    n = F.least(F.size(pieces) - 1, F.lit(most))
    before = F.slice(F.transform(pieces, lambda p: F.length(p)), 1, F.greatest(n, F.lit(0)))
    walked = F.aggregate(
        before,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, size: F.struct((s["at"] + size + F.length(needle)).alias("at"), F.array_append(s["found"], s["at"] + size).alias("found")),
    )
    return F.when(F.length(needle) > 0, walked["found"]).otherwise(F.array().cast("array<int>"))


def snippet(text: Column, at: Column, size: Column, pad: int = 34) -> Column:
    """The surroundings of a match, where the match begins in them, and whether text was left off."""
    start, end = F.greatest(F.lit(0), at - pad), F.least(F.length(text), at + size + pad)
    return F.struct(
        F.substring(text, start + 1, end - start).alias("text"), (at - start).alias("offset_in_snippet"), (start > 0).alias("prefix_trimmed"), (end < F.length(text)).alias("suffix_trimmed")
    )


def segments(text: Column, size: int = 300) -> Column:
    """Beginning, middle and end of a text, as far as it is long enough for each."""
    long = F.length(text)
    part = lambda label, body: F.struct(F.lit(label).alias("label"), body.alias("text"))
    found = F.array(
        part("开头", F.substring(text, 1, size)),
        F.when(long > 4 * size, part("中间", F.substring(text, F.floor(long / 2).cast("int") + 1, F.lit(size)))),
        F.when(long > 3 * size, part("结尾", F.right(text, F.lit(size)))),
    )
    return F.array_compact(found)


def format_bytes(c: Column, largest: str = "GB") -> Column:
    """B, KB, MB or GB by powers of 1024, with one decimal from KB on. largest: MB for sizes that are shown in no greater unit, as those of backups are."""
    unit = lambda n, name: F.concat(F.format_number(c / 1024**n, 1), F.lit(f" {name}"))
    small = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024**2, unit(1, "KB"))
    return small.otherwise(unit(2, "MB")) if largest == "MB" else small.when(c < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def format_duration(ms: Column) -> Column:
    """Hours and minutes, minutes, or seconds."""
    s = F.floor(ms / 1000).cast("long")
    hours, minutes = F.expr("0") + F.floor(s / 3600), F.floor(s / 60) % 60
    text = lambda n: n.cast("long").cast("string")
    return F.when(s >= 3600, F.concat(text(hours), F.lit(" 小时 "), text(minutes), F.lit(" 分钟"))).when(s >= 60, F.concat(text(minutes), F.lit(" 分钟"))).otherwise(F.concat(text(s), F.lit(" 秒")))
