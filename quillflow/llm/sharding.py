"""Operator 2: shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Documents of equal text form a group that stays in one shard. Differencing keeps partial partitions of all piles in a heap and combines the
two of largest spread, oppositely ordered, until one is left. It runs over items of two kinds: every group of more than 1 / (shards * LARGE)
of all bytes is an item of its own (there are at most shards * LARGE of them), and all others are dealt by their text's hash into a fixed
number of bundles, in tiers of which each is finer than the one before, so that the last items to be combined are small. The number of items
is bounded by the number of shards, whatever the size of the input, and with few groups most bundles are single groups.

Defined results: a null text has size OVERHEAD and no crc32, and all null texts form one group; an empty text is another group;
rows that repeat are documents of their own; an empty table gives no rows. A group larger than a shard's mean fills its shard alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import stage

#: Bytes that each row counts beside its text.
OVERHEAD = 8
#: Items of their own: groups of over 1 / LARGE of a shard.
LARGE = 64
#: Tiers of bundles: thousandths of the hash space, bundles a shard.
TIERS = ((900, 128), (90, 32), (9, 16), (1, 8))
#: Ranges of a shard in which slots are numbered.
RANGES = 512


def differencing(sizes: Sequence[int], piles: int) -> list[int]:
    """The pile of each item, by Karmarkar-Karp."""
    pile = [0] * len(sizes)
    heap = [(-size, i, [(size, [i])] + [(0, [])] * (piles - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x + y, [*i, *j] if i and j else i or j) for (x, i), (y, j) in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], tie, both))
        tie += 1
    for _, _, parts in heap:
        for n, (_, items) in enumerate(parts):
            for i in items:
                pile[i] = n
    return pile


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard) for each row of docs (doc_id, text)."""
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    group = F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))
    rows = stage(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), group.alias("group")), "shard-rows")

    place, item, first = F.pmod("group", F.lit(1000)), None, 0
    index = F.shiftright("group", 10)
    for tier, (width, each) in enumerate(TIERS):
        bundle = F.concat(F.lit(f"{tier}/"), F.pmod(index, F.lit(shards * each)).cast("string"))
        item = F.when(place < first + width, bundle) if item is None else item.when(place < first + width, bundle)
        first += width
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    large = F.col("size") * shards * LARGE > F.lit(total)
    items = groups.groupBy(F.when(large, F.concat(F.lit("="), F.col("group").cast("string"))).otherwise(item).alias("item")).agg(F.sum("size").alias("size"))
    # at most shards * (LARGE + the bundles a shard) rows
    found = sorted((r.size_, r.item) for r in items.withColumnRenamed("size", "size_").collect())
    pile = differencing([s for s, _ in found], shards)
    plan = rows.sparkSession.createDataFrame([(name, n) for (_, name), n in zip(found, pile)], "item string, shard int")
    alone = F.concat(F.lit("="), F.col("group").cast("string"))
    own, rest = plan.filter(F.col("item").startswith("=")), plan.filter(~F.col("item").startswith("="))
    placed = rows.withColumn("alone", alone).join(F.broadcast(own.select(F.col("item").alias("alone"), F.col("shard").alias("own"))), "alone", "left")
    placed = placed.withColumn("item", item).join(F.broadcast(rest), "item", "left").withColumn("shard", F.coalesce("own", "shard"))

    key = F.xxhash64("doc_id", "group")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", key.alias("key")).withColumn("range", F.pmod("key", F.lit(RANGES)))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "doc_id")) - 1
    numbered = placed.join(counts.withColumn("before", before).drop("n"), ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + within).cast("long").alias("slot"))
