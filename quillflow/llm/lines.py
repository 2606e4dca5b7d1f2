"""Operator 11: lines that many documents share are dropped from all but the last of them.

Method: each line's key is hashed to 128 bits and sent, with its document and position but without any text, to ranges of (hash, document,
position), which Spark sorts on arrival. Within the ranges a document's first occurrence of a key is told by the row before it, so that documents,
not lines, are counted; each range's counts and last documents are combined before they are exchanged. What comes back for a document is a compressed
bitmap of the lines it keeps, as runs (first line, lines); texts meet their bitmaps once, and are never exchanged by line.

Only DataFrame functions are used. Ranges of (hash, document) cut a line that is in a third of all documents into as many ranges as it needs. Such
keys are few: those with over one in HOT of all occurrences number fewer than HOT, so they go to every task; the others meet their last document by
a join in which no key is large.

Defined results: a null or empty text is one empty line. Rows of one doc_id are one document in counting, and all of them are its rows; rows without a
doc_id together are one document, the first of all in order. A row that repeats is judged and returned as often. Lines of equal key in the last
document all stay. An empty table gives no rows. Other columns, whatever their names, are left aside. A collision of two keys' 128 bits is not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import BROADCAST_ROWS, lightly, stage

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if over one in so many of all lines have it; so there are fewer hot keys than this.
HOT = 1000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """hash, more (128 bits of the key), doc_id, text_hash and position of each line whose key has at least so many code points."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    keyed = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).filter(F.length("line") >= least).withColumn("line", F.translate("line", UPPER, LOWER))
    # the second half has another seed: the hash of 1
    return keyed.select(F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(1), "line").alias("more"), "doc_id", "text_hash", "position")


def placed(found: DataFrame) -> DataFrame:
    """occurrences in sorted ranges, with `first`: 1 where a document has the key for the first time. The window takes the ranges as they are."""
    within = Window.partitionBy("hash", "more", "doc_id").orderBy("position")
    ranges = found.repartitionByRange("hash", "more", "doc_id").sortWithinPartitions("hash", "more", "doc_id", "position")
    return ranges.withColumn("first", F.lag("position").over(within).isNull().cast("int"))


def shared_keys(placed: DataFrame, documents: int) -> DataFrame:
    """hash, more, last (the greatest doc_id) and n_lines of keys that so many documents hold."""
    keys = placed.groupBy("hash", "more").agg(F.sum("first").alias("n_documents"), F.max("doc_id").alias("last"), F.count("*").alias("n_lines"))
    return keys.filter(F.col("n_documents") >= documents).select("hash", "more", "last", "n_lines")


def keep_bitmaps(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """doc_id, text_hash, n_dropped, runs: the bitmap of each document that loses lines.

    docs: doc_id, text. runs: array of (start, n) in order: the lines that stay before the last that goes, from line `start` on n of them; after that
    line all stay, so the last run has no end of its own: its n is null.
    """
    lines = stage(placed(occurrences(docs, least)), "lines-ranges")
    # a part of the table has a key's rows together, so they are one row before the exchange
    shared = stage(shared_keys(lines, documents), "lines-shared")
    total = lines.count()
    hot = shared.filter(F.col("n_lines") * HOT > total)
    cold = shared.filter(F.col("n_lines") * HOT <= total)
    goes = lambda keys: lines.join(keys.select("hash", "more", "last"), ["hash", "more"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    dropped = goes(F.broadcast(hot)).unionByName(goes(lightly(cold))).select("doc_id", "text_hash", "position").distinct()
    listed = dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("position")).alias("gone"))
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    after = F.concat(F.transform("gone", lambda p: p.cast("int")), F.array(F.lit(None).cast("int")))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n")))
    return listed.select("doc_id", "text_hash", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["n"].isNull() | (r["n"] > 0)).alias("runs"))


def without_shared_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines that stay, joined by a newline) of each row."""
    bitmaps = stage(keep_bitmaps(docs.select("doc_id", "text"), least, documents), "lines-bitmaps")
    # a run is two numbers, some 16 bytes: the bitmaps go to every task only if they are small for certain
    rows, runs = bitmaps.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    small = F.broadcast(bitmaps) if rows + runs <= BROADCAST_ROWS else bitmaps
    judged = small.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_dropped", "runs")
    both = docs.select("doc_id", "text").join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    lines = split_lines(F.col("text"))
    stays = F.flatten(F.transform("runs", lambda r: F.slice(F.col("_lines"), r["start"] + 1, F.coalesce(r["n"], F.size("_lines")))))
    cut = both.withColumn("_lines", lines)
    kept = F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return cut.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))
