"""Titles of books and chapters: skeletons, similarity, numbers, and the rules that find headings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.functions.text import SPACE, WS, trim

# Characters that a skeleton leaves out, and brackets whose content goes as well.
NOISE = r"[·・:：\-_—.,，。！!？?、'\"“”‘’《》<>]"
BRACKETED = r"[（(\[【][^）)\]】]*[）)\]】]"
# Numerals in chapter titles.
NUMERAL = "0-9０-９零〇一二三四五六七八九十百千万两"
CN_DIGITS, CN_VALUES = "零〇一二两三四五六七八九", "001223456789"
WIDE_DIGITS, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"
CN_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
# Words that make a heading without a number.
NAMED_HEADINGS = "序章|序言|自序|楔子|引子|前言|后记|尾声|终章|大结局|外篇|番外(?:篇)?"
MAX_LINE, MAX_TAIL = 60, 45


def skeleton(title: Column, brackets: bool = True) -> Column:
    """A title without white space, punctuation and case; with brackets, also without what stands in brackets."""
    bare = F.regexp_replace(title, BRACKETED, "") if brackets else title
    return F.lower(F.regexp_replace(F.regexp_replace(bare, f"{WS}+", ""), NOISE, ""))


def bigrams(text: Column) -> Column:
    """The different pairs of neighbouring characters; a single character stands for itself."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def _numeral(raw: Column) -> Column:
    """Chinese numerals, digit by digit: a unit multiplies what was read since the last unit (one if nothing was)."""
    units = F.create_map(*[F.lit(x) for pair in CN_UNITS.items() for x in pair])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"))

    def step(s: Column, ch: Column) -> Column:
        digit, unit = F.translate(ch, CN_DIGITS, CN_VALUES).try_cast("long"), units[ch]
        own = (digit.isNotNull()) & ~ch.rlike("[0-9０-９]")
        return (
            F.when(own, F.struct(s["total"].alias("total"), (s["part"] * 10 + digit).alias("part")))
            .when(unit.isNotNull(), F.struct((s["total"] + F.greatest(s["part"], F.lit(1)) * unit).alias("total"), F.lit(0).cast("long").alias("part")))
            .otherwise(s)
        )

    read = F.aggregate(F.split(raw, ""), zero, step)
    return F.nullif(read["total"] + read["part"], F.lit(0).cast("long"))


def chapter_number(title: Column) -> Column:
    """The number in a chapter's title, or null: 第12章, 第十二章, "12. ", Chapter 12."""
    raw = F.regexp_extract(title, f"第{WS}*([{NUMERAL}]{{1,12}}){WS}*[章回节卷篇集]", 1)
    plain = F.translate(raw, WIDE_DIGITS, ASCII_DIGITS).try_cast("long")
    leading = F.regexp_extract(title, f"^{WS}*([0-9]{{1,5}}){WS}*[.．、:：]", 1).try_cast("long")
    english = F.regexp_extract(title, f"(?i)Chapter{WS}*([0-9]{{1,5}})", 1).try_cast("long")
    return F.when(raw != "", F.when(raw.rlike("^[0-9０-９]+$"), plain).otherwise(_numeral(raw))).otherwise(F.coalesce(leading, english))


_LEAD = f"^{WS}*(?:#{{1,4}}{WS}*)?"
_NUMBERED = f"第{WS}*[{NUMERAL}]{{1,12}}{WS}*"
_REST = f"{WS}*[：:、.．\\-—]?{WS}*(.*?){WS}*$"
#: Heading rules; group 1 is the number or name, group 2 the title proper.
HEADINGS = {
    "default": f"{_LEAD}({_NUMBERED}[章回节卷篇集部]|Chapter{WS}*\\d{{1,5}}|(?:{NAMED_HEADINGS})){_REST}",
    "chapter-only": f"{_LEAD}({_NUMBERED}章){_REST}",
    "with-number": f"^{WS}*(\\d{{1,4}}){WS}*[.．、:：]{WS}*([^{SPACE}].{{0,44}}){WS}*$",
    "markdown": f"^{WS}*(#{{1,4}}){WS}+([^{SPACE}].{{0,44}}){WS}*$",
}


class BadPattern(ValueError):
    """A heading pattern that does not compile, or a rule that does not exist."""


def heading_pattern(rule: str = "default", pattern: str | None = None, ignore_case: bool = False) -> str:
    """A built-in rule's pattern, or one's own after a check of its syntax."""
    if pattern is None:
        if rule not in HEADINGS:
            raise BadPattern(f"no heading rule {rule!r}; there are {', '.join(HEADINGS)}")
        return HEADINGS[rule]
    try:
        re.compile(pattern)
    except re.error as why:
        raise BadPattern(f"heading pattern {pattern!r}: {why}") from None
    return f"(?i){pattern}" if ignore_case else pattern


def heading_groups(pattern: str) -> int:
    try:
        return re.compile(pattern.replace("\\x0b", "\\x0b")).groups
    except re.error:
        return 2


def is_heading(line: Column, pattern: str, max_line: int = MAX_LINE) -> Column:
    """Whether a line is a heading: short, matched, and what follows the number no sentence."""
    bare = trim(line)
    # the built-in rules take white space at both ends themselves, so that most lines need one look at their beginning
    likely = line.rlike(pattern) if pattern in HEADINGS.values() else F.lit(True)
    tail = trim(F.coalesce(F.regexp_extract(bare, pattern, 2), F.lit(""))) if heading_groups(pattern) >= 2 else F.lit("")
    return likely & (bare != "") & (F.length(bare) <= max_line) & bare.rlike(pattern) & (F.length(tail) <= MAX_TAIL) & ~tail.rlike("[。！？；…]")
