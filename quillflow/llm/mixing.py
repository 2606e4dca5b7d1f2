"""Operator 1: mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream: its documents, shuffled by hash, cut into blocks of equal words. A slot of the schedule takes one block.
Slot n has the point frac(n * golden ratio), which falls into one source's share of [0, 1); the slot's rank among its source's slots
is the number of the block that it takes. A source that goes round starts its stream again, so no document is taken more than twice.

Only DataFrame functions are used. Cumulative sums (where a document starts in its stream, the rank of a slot) are taken in two levels,
within hash or slot ranges and then over the ranges' totals, so that a source with most of the rows is still spread over tasks.
Numbers of slots are longs, and their points are taken without a product that could leave them.

Defined results: a null or empty text has no words, size 0, and is never taken; a null source is a source of its own, the last in order;
rows that repeat are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import stage, unused, word_count

#: The low-discrepancy points are (n * GOLDEN mod 2**32) / 2**32; n counts modulo 2**31, which keeps the product within a long.
GOLDEN, POINTS = 2654435769, 1 << 32
#: Cells of [0, 1) by which slots meet their source's share.
CELLS = 4096
#: Least hash ranges of a source's stream (as bits), and least slots in a range of the schedule. Both grow with the square root of what they divide, so
#: that neither a range nor the ranges of a source are much for one task.
RANGE_BITS, SLOT_RANGE = 10, 512


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) with source_no, weight and target.

    Sources by code point, null last, have the weights in turn. Together they get share times all words; a target stops at most times its
    source's size and the rest is shared again by weight: target = min(cap, level * weight), with the level found from the sources in order
    of cap / weight. The table has one row a source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    numbered = sizes.withColumn("source_no", F.row_number().over(every) - 1).withColumn("weight", turn[F.col("source_no") % len(weights)]).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return numbered.withColumn("level", level).withColumn("target", F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("weight"))).drop("level", "cap")


def _running(df: DataFrame, group: str, part: str, order: Sequence[str | Column], add: Column, name: str) -> DataFrame:
    """df with name: the sum of add over the rows before, by group, in the order of part and then order."""
    totals = df.groupBy(group, part).agg(F.sum(add).alias("_sum"))
    over = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    within = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [group, part]).withColumn(name, F.col("_before") + F.coalesce(F.sum(add).over(within), F.lit(0))).drop("_before")


def _shares(sources: DataFrame, slots: int) -> DataFrame:
    """A row for each source (source_no, need) and cell of [0, 1) that it touches: its share is from low to below high, of POINTS."""
    by_no = Window.orderBy("source_no")
    upto = F.sum("need").over(by_no) / F.lit(float(max(1, slots)))
    shares = sources.withColumn("high", F.floor(upto * F.lit(float(POINTS))).cast("long")).withColumn("low", F.coalesce(F.lag("high").over(by_no), F.lit(0).cast("long")))
    width = POINTS // CELLS
    return shares.filter("high > low").select("source_no", "low", "high", "need", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))


def _drawn(shares: DataFrame, slots: DataFrame) -> DataFrame:
    """slot, source_no and need: the source into whose share each slot's point falls."""
    points = slots.withColumn("point", (F.col("slot") % F.lit(1 << 31)) * F.lit(GOLDEN) % F.lit(POINTS))
    drawn = points.withColumn("cell", F.expr(f"point div {POINTS // CELLS}")).join(shares, "cell").filter("point >= low and point < high")
    return drawn.select("slot", "source_no", "need")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """The documents' measures, and the schedule.

    docs: doc_id, text, source. First result, one row a document: doc_id, source, size, source_size, target, source_no, key (of its text and id), start (its first
    word in its source's stream). Second, one row for each piece of a document in a block that a slot takes: slot, source_no, doc_id, start,
    round (0, 1, ...: how often the stream was taken before), from_word (of the document), n_words. Slots in order are the mix.
    A source gets floor(target) words exactly; where the points give it some slots too few, they follow at the end, and slots too many take nothing.
    """
    spark = docs.sparkSession
    # the text's hash only tells apart rows that repeat an id
    measured = stage(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("key")), "mix-sizes")
    sources = stage(targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-sources")
    need = F.ceil(F.floor("target") / F.lit(block)).cast("long")
    sources = sources.withColumn("quota", F.floor("target").cast("long")).withColumn("need", need)
    slots, n_sources = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()

    placed = measured.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    bits = max(RANGE_BITS, min(20, measured.count().bit_length() // 2))
    placed = placed.withColumn("range", F.shiftrightunsigned("key", 64 - bits))
    placed = _running(placed, "source_no", "range", ["key", "doc_id"], F.col("size"), "start")
    placed = stage(placed.select("doc_id", "source", "size", "source_size", "target", "source_no", "quota", "key", "start"), "mix-streams")

    drawn = _drawn(_shares(sources, slots), spark.range(slots).select(F.col("id").alias("slot")))
    drawn = drawn.select("slot", "source_no", "need", F.expr(f"slot div {max(SLOT_RANGE, math.isqrt(slots))}").alias("range"))
    drawn = stage(_running(drawn, "source_no", "range", ["slot"], F.lit(1), "rank").select("slot", "source_no", "rank", "need"), "mix-slots")
    got = drawn.groupBy("source_no").agg(F.count("*").alias("got"))
    short = sources.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = short.select("source_no", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).withColumn("slot", F.lit(slots) + F.col("rank") * F.lit(n_sources) + F.col("source_no"))
    schedule = drawn.filter("rank < need").select("slot", "source_no", "rank").unionByName(late.select("slot", "source_no", "rank"))

    rounds = placed.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.expr("greatest(0, cast(ceil(quota / source_size) as int) - 1)"))))
    rounds = rounds.withColumn("first", F.col("start") + F.col("round") * F.col("source_size")).withColumn("last", F.least(F.col("first") + F.col("size"), F.col("quota"))).filter("first < last")
    pieces = rounds.withColumn("rank", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(last - 1) div {block}"))))
    begin, end = F.greatest(F.col("first"), F.col("rank") * block), F.least(F.col("last"), (F.col("rank") + 1) * block)
    pieces = pieces.select("source_no", "rank", "doc_id", "start", "round", (begin - F.col("first")).alias("from_word"), (end - begin).alias("n_words"))
    mixed = pieces.join(schedule, ["source_no", "rank"]).select("slot", "source_no", "doc_id", "start", "round", "from_word", "n_words")
    return placed.drop("quota"), mixed


def taken(docs: DataFrame, **how: object) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (the words of it in the mix, repeats counted)."""
    measured, mixed = mix(docs, **how)
    key = ["doc_id", "source_no", "start"]
    rows = measured.filter("size > 0").withColumn("n_words", F.lit(0).cast("long"))
    rest = mixed.select(*key, "n_words")
    summed = rows.unionByName(rest, allowMissingColumns=True).groupBy(*key).agg(*[F.max(c).alias(c) for c in ("source", "size", "source_size", "target")], F.sum("n_words").alias("taken"))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return summed.select(*names).unionByName(measured.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*names))


def repeat_mixed(docs: DataFrame, **how: object) -> DataFrame:
    """docs, each row as often as the mix takes it to the nearest whole (half up): 0, 1 or 2 times. Rows of no words stay once; columns stay as they are."""
    # a row is known by its source and the hash of its id and text, as where it stands in its source's stream follows from them; rows that are equal in these share what they take
    own, took, size, copy, of = (unused(docs, n) for n in ("_own_key", "_taken", "_size", "_copy", "_source_of"))
    measured, mixed = mix(docs, **how)
    words = mixed.groupBy("source_no", "doc_id", "start").agg(F.sum("n_words").alias("words"))
    named = words.select(F.col("source_no").alias("_no"), F.col("start").alias("_at"), F.col("doc_id").alias("_id"), "words")
    # of one start in a source only one row has words, so rows of no words meet none
    met = measured.filter("size > 0").join(named, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    counts = stage(met.groupBy(F.col("key").alias(own), F.col("source").alias(of)).agg(F.coalesce(F.sum("words"), F.lit(0)).alias(took), F.sum("size").alias(size)), "mix-counts")
    times = F.when(F.col(size).isNull(), 1).otherwise(F.floor(F.col(took) / F.col(size) + 0.5).cast("int"))
    same = (F.xxhash64("doc_id", "text") == F.col(own)) & F.col("source").eqNullSafe(F.col(of)) & (word_count("text") > 0)
    rows = docs.join(counts, same, "left").select(*[docs[c] for c in docs.columns], times.alias(copy))
    return rows.withColumn(copy, F.explode(F.when(F.col(copy) > 0, F.sequence(F.lit(1), F.col(copy))))).select(*docs.columns)
