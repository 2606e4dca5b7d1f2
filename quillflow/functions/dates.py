"""Days, weeks and check times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.schemas import CHECK_DAYS


def day(c: Column) -> Column:
    """YYYY-MM-DD in the session's time zone."""
    return F.date_format(c, "yyyy-MM-dd")


def week_start(c: Column) -> Column:
    """The Monday of a time's week."""
    return day(F.date_trunc("week", c))


def next_check(mode: Column, since: Column) -> Column:
    """When an item is due again; null for modes without a rhythm."""
    days = F.create_map(*[F.lit(x) for pair in CHECK_DAYS.items() for x in pair])[mode]
    return F.when(days.isNotNull(), since + F.make_dt_interval(days))


def millis(c: Column) -> Column:
    """Milliseconds since the epoch; 0 for null."""
    return F.coalesce(F.unix_millis(c.cast("timestamp")), F.lit(0).cast("long"))


def relative(c: Column, now: Column) -> Column:
    """How long ago a time was, in words: just now, minutes, hours, yesterday, days; the date from a week on."""
    minutes = F.floor((millis(now) - millis(c)) / 60_000)
    days = F.date_diff(now, c)
    count = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}前"))
    return (
        F.when(c.isNull(), "").when(minutes < 1, "刚刚").when(minutes < 60, count(minutes, "分钟")).when(days == 0, count(F.floor(minutes / 60), "小时"))
        .when(days == 1, "昨天").when(days < 7, count(days, "天")).otherwise(day(c))
    )
