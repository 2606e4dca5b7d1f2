"""Values of any type to the type wanted, never failing; also under ANSI mode, where a plain cast raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.functions.text import trim


def as_string(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def as_trimmed(c: Column, default: str = "") -> Column:
    return F.coalesce(trim(c.cast("string")), F.lit(default))


def as_long(c: Column, default: int | None = 0) -> Column:
    """Truncated towards zero; an empty text is 0, what is no number or not finite the default."""
    text = trim(c.cast("string"))
    number = text.try_cast("double")
    whole = F.when(text == "", F.lit(0).cast("long")).when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None).cast("long")).otherwise(number.try_cast("long"))
    return whole if default is None else F.coalesce(whole, F.lit(default).cast("long"))


def as_int(c: Column, default: int | None = 0) -> Column:
    return as_long(c, default).try_cast("int")


def as_count(c: Column) -> Column:
    return F.greatest(as_int(c, 0), F.lit(0))


def as_ratio(c: Column) -> Column:
    number = c.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def as_bool(c: Column) -> Column:
    text = F.lower(trim(c.cast("string")))
    return F.coalesce(~text.isin("false", "0", ""), F.lit(False))


def as_time(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string"))


def as_enum(c: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(c.cast("string").isin(list(allowed)), c.cast("string")).otherwise(F.lit(default))


def as_strings(c: Column) -> Column:
    """Trimmed, empty ones dropped, each once and in the order of first appearance."""
    texts = F.transform(c.cast("array<string>"), lambda x: trim(x))
    return F.coalesce(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))
