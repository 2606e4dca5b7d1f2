"""Operator 6, at a similarity: SimHash blocks for pairs of word shingles whose Jaccard similarity is 0.8 or more.

A pair of similarity s has sets of shingles at an angle of arccos(2s / (1 + s)), and each bit of a SimHash differs with that angle / pi: 0.15 at
0.8, too much for three bits of 64. So the fingerprint is wide (BITS), and its pigeonhole blocks are many: `blocks` of them, of so many bits that
unrelated texts rarely share one, however many texts there are, and so many that a pair at the limit shares one with a probability of RECALL.

1. Texts of equal sets of shingles are one class, and only classes are compared: a group of copies is one row.
2. Classes that share a block are verified by Hamming distance. What goes on is a minimum spanning forest of the close ones of a block's group. A group of over
   `group` members goes on as a whole, unverified: that can only make a family larger, and what is compared in a large family step 3 decides by its shingles.
   Components are families: a pair that shares a block and is close lies within one family, and links are fewer than rows.
3. Within a family the whole sets of shingles are compared, every pair of classes that exact links do not connect yet, so no pair is lost to the forest.
   A family of over `group` members, or too many shingles for a task, is compared by a prefix filter: its members meet at their rarest shingles, where alone two of that
   similarity can. They are first tested against one hub for each shingle, and those hubs connect drop out together; then those that still may reach the similarity
   go to the cells, each of two parts of the family, in which they meet. Texts of a template that differ in what is their own meet nowhere.

Links out of every step span what they connect, so a dense group costs no square of its size in rows, and components are those of all pairs.

Defined results: A-Z is lower-cased; a text of fewer words than a shingle is one shingle; null and empty texts are one class; rows that repeat are one class; the
component id is the least doc_id of the component, null ids left out (null if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, grams, lightly, mix, pieces, stage, texts, unused, word_ranges
from quillflow.llm.components import one_row_of_each, roots

COORDINATES, BITS = 2048, 512
#: Share of the pairs at the limit that share a block; least bits of a block, and members of a group by chance, from which its bits follow.
RECALL, LEAST_KEY, BY_CHANCE = 0.98, 16, 64
#: Shingles of a part of a family at most (a longer text is a part of its own); rounds of hubs in large families; and members with a shingle that a task pairs with others at once.
PART_SHINGLES, HUBS, PAIRED = 1 << 21, 2, 4096
SEED = 6
PRINT = [f"f{i}" for i in range(BITS // 64)]
CELL = ["family", "low", "high", "part", "class", "root", "shingles"]


def _eased(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """pieces of batches; at their end the memory that this worker has freed goes back to the system, as workers live on from task to task."""
    yield from pieces(batches, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (COORDINATES, BITS))


def _differ(similarity: float) -> float:
    """The share of bits in which a pair of that similarity differs, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near(similarity: float) -> int:
    """Differing bits of the first 128 up to which a pair goes on: 3.6 deviations over the average (34 at 0.8, whose average is 19.4; unrelated texts have 64)."""
    p = _differ(similarity)
    return math.ceil(128 * p + 3.6 * math.sqrt(128 * p * (1 - p)))


def blocks(classes: int, similarity: float) -> list[np.ndarray]:
    """The bits of each block's key. Bits grow with the logarithm of the classes, so that groups by chance do not grow, and the number of blocks with the bits."""
    bits = min(46, max(LEAST_KEY, math.ceil(math.log2(max(2, classes) / BY_CHANCE))))
    agree = (1 - _differ(similarity)) ** bits
    rng = np.random.default_rng(SEED + 1)
    return [rng.choice(BITS, bits, replace=False) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))]


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each different shingle, in order."""
    words, row = t.hashes(), t.row_of_word()
    start = np.flatnonzero(np.arange(len(words)) + n <= t.ends())
    count = np.diff(t.word_at)
    short = np.flatnonzero((count > 0) & (count < n))
    got = np.concatenate([grams(words, n)[start] if len(start) else np.zeros(0, np.uint64), word_ranges(words, t.word_at[short], t.word_at[short] + count[short])])
    of = np.concatenate([row[start], short])
    order = np.lexsort((got, of))
    of, got = of[order], got[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1])
    return of[new], got[new]


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(batch.column(batch.schema.get_field_index("text")))


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    at = np.searchsorted(row, np.arange(rows + 1))
    return total[at[1:]] - total[at[:-1]]


def classes_of(row: np.ndarray, got: np.ndarray, rows: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's set of shingles, and a second one; sets that are in `other` by their first hash have the second for the first."""
    size = np.bincount(row, minlength=rows).astype(np.uint64)
    first, second = (mix(_sums(row, mix(got ^ np.uint64(s)), rows) + size) for s in (0x51ED27, 0x2545F491))
    return np.where(np.isin(first, other), second, first), second


def _described(words: int):
    """Each row's class, its number of shingles, and, once in a slice, the class's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = _projection()
        for batch in _eased(batches):
            ids = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "at")]
            for t in texts(_lowered(batch)):
                row, got = shingles(t, words)
                first, second = classes_of(row, got, t.rows, np.zeros(0, np.uint64))
                _, own = np.unique(first, return_index=True)
                place = np.full(t.rows, -1)
                place[own] = np.arange(len(own))
                at = place[row]
                at, signed = at[at >= 0], got[at >= 0]
                sign = np.where(signed >> np.uint64(63), 1.0, -1.0)
                vectors = np.bincount(at * COORDINATES + (signed % np.uint64(COORDINATES)).astype(np.int64), sign, len(own) * COORDINATES).reshape(len(own), COORDINATES).astype(np.float32)
                fp = np.zeros((t.rows, len(PRINT)), np.int64)
                fp[own] = np.packbits(vectors @ projection > 0, axis=1).view(np.int64)
                size = np.bincount(row, minlength=t.rows)
                columns = [x.slice(t.first, t.rows) for x in ids] + [pa.array(x) for x in (first.view(np.int64), second.view(np.int64), size)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, mask=place < 0) for x in np.ascontiguousarray(fp.T)], ["doc_id", "at", "class", "second", "size", *PRINT])

    return run


def _keyed(chosen: list[np.ndarray]):
    """A row for each block and class."""
    masks, n = np.stack(chosen), len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(masks.shape[1])
        for batch in _eased(batches, 4096):
            fp = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in PRINT], axis=1)
            bits = np.unpackbits(fp.view(np.uint8), axis=1)
            key = np.stack([bits[:, k] @ weights for k in masks], axis=1) + (np.arange(n) << masks.shape[1])
            flat = lambda x: pa.array(np.repeat(x, n))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(flat(x) for x in (batch.column("class").to_numpy(zero_copy_only=False), fp[:, 0], fp[:, 1]))], ["key", "class", "fp0", "fp1"])

    return run


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (up to most bits) of a minimum spanning forest."""
    n = len(fp)
    best, by, left, edges, now = np.full(n, 999), np.zeros(n, np.int64), np.ones(n, bool), [], 0
    for _ in range(n - 1):
        left[now] = False
        far = np.bitwise_count(fp ^ fp[now]).sum(axis=1)
        closer = left & (far < best)
        best[closer], by[closer] = far[closer], now
        now = int(np.argmin(np.where(left, best, 1000)))
        if best[now] <= most:
            edges.append((int(by[now]), now))
    return edges


def _close(most: int, group: int):
    """Rows in order of key to links (a, b): a forest of the members of a key within most bits, or a star of all of them where they are over group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = [np.zeros(0, np.int64)] * 4, None  # rows of the last key so far; key and centre of a star that is under way

        def links(new: list[np.ndarray], ended: bool) -> pa.RecordBatch:
            nonlocal held, hub
            rows = [np.concatenate(c) for c in zip(held, new)]
            key, ids, fp = rows[0], rows[1], np.stack(rows[2:], axis=1).view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            sizes = np.diff(bounds)
            whole = len(sizes) - (not ended)  # groups that are known to have ended
            # small groups: is any pair close? by distance in the order, all groups at once
            of, busy, small = np.repeat(np.arange(len(sizes)), sizes), sizes > 64, sizes <= 64
            for d in range(1, int(sizes[small].max(initial=1))):
                at = np.flatnonzero((of[d:] == of[:-d]) & small[of[d:]])
                busy[of[at[np.bitwise_count(fp[at + d] ^ fp[at]).sum(axis=1) <= most]]] = True
            a, b = [], []
            for g in range(len(sizes)) if hub is not None or sizes.max(initial=0) > group else np.flatnonzero(busy[: max(0, whole)]).tolist():
                s, e = int(bounds[g]), int(bounds[g + 1])
                under_way = hub is not None and hub[0] == key[s]
                if under_way or e - s > group:
                    hub = hub if under_way else (key[s], int(ids[s]))
                    a += [hub[1]] * (e - s)
                    b += ids[s:e].tolist()
                elif g < whole and busy[g]:
                    edges = _forest(fp[s:e], most)
                    a += [int(ids[s + i]) for i, _ in edges]
                    b += [int(ids[s + j]) for _, j in edges]
            if len(sizes) and not ended:
                s = int(bounds[-2])
                held = [x[len(key) if hub is not None and hub[0] == key[s] else s :] for x in rows]
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            yield links([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "class", "fp0", "fp1")], False)
        yield links([np.zeros(0, np.int64)] * 4, True)

    return run


def _sets(words: int, other: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _eased(batches):
            for t in texts(_lowered(batch)):
                row, got = shingles(t, words)
                at = np.searchsorted(row, np.arange(t.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(row, got, t.rows, other)[0].view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(got.view(np.int64)))], ["class", "shingles"])

    return run


def spanning(root: np.ndarray, sizes: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) of left with right that connect what all pairs of that similarity connect. Members of one root are connected; flat holds all their sets."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    of, number = of[shared], number[shared]
    order = np.argsort(number, kind="stable")
    owners = of[order]
    first = np.searchsorted(number[order], np.arange(len(times) + 1))
    at = np.searchsorted(of, np.arange(len(sizes) + 1))
    component, out = np.unique(root, return_inverse=True)[1], []
    candidate = np.zeros(len(sizes), bool)
    candidate[right] = True
    for i in left.tolist():
        if not (component[right] != component[i]).any():
            continue
        mine = number[at[i] : at[i + 1]]
        n = first[mine + 1] - first[mine]
        met = owners[np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        common = np.bincount(met, minlength=len(sizes))
        linked = candidate & (component != component[i]) & (common >= similarity * (sizes[i] + sizes - common) - 1e-9)
        for j in np.flatnonzero(linked).tolist():
            if component[j] != component[i]:
                out.append((i, j))
                component[component == component[j]] = component[i]
    return out


def _compare(similarity: float):
    """Rows in order of (family, low, high), a cell of the family's parts, to links of classes: of two parts, or within one."""
    def cell(x: list) -> pa.RecordBatch:
        low, high, part, ids, root = (np.concatenate([c.to_numpy(zero_copy_only=False) for c in x[i]]) for i in range(1, 6))
        lists = pa.concat_arrays(x[6])
        left = np.flatnonzero(part == low[0])
        right = np.flatnonzero(part == high[0])
        edges = spanning(root, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), left, right, similarity)
        return pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i, _ in edges], pa.int64()), pa.array([int(ids[j]) for _, j in edges], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [[] for _ in CELL], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in CELL]
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if now is not None and now != tuple(keys[s]):
                    yield cell(held)
                    held = [[] for _ in CELL]
                now = tuple(keys[s])
                for h, c in zip(held, columns):
                    h.append(c.slice(s, e - s))
        if now is not None:
            yield cell(held)

    return run


def _cut(sets: DataFrame, group: int) -> DataFrame:
    """sets (family, size and others) with parts, the number of parts that a family is cut into, and part."""
    parts = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int")
    return sets.join(lightly(sets.groupBy("family").agg(parts.alias("parts"))), "family").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))


def _verified(cells: DataFrame, similarity: float) -> DataFrame:
    """cells: CELL. Links (a, b) of classes that span those of the similarity in each cell (family, low, high), between its two parts."""
    rows = cells.select(CELL).repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "class")
    return rows.mapInArrow(_compare(similarity), "a long, b long")


def prefixes(large: DataFrame, similarity: float) -> DataFrame:
    """Where members of large families (family, class, size, part, shingles) may meet: a row for each shingle of a member's prefix that another member has.

    A member's shingles are put in order of the family's count of them, rare ones first. Two sets of that similarity share so many that they share one
    of the first ones: the prefix, at 0.8 a fifth of a set. `rest` counts the shingle and all that others have after it: sets whose first common
    shingle this is have no more in common than the lesser of their rests.
    """
    all_ = large.select("family", "class", "size", "part", F.explode("shingles").alias("shingle"))
    often = all_.groupBy("family", "shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = all_.join(often, ["family", "shingle"]).groupBy("family", "class", "size", "part").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("met"))
    first = F.floor(F.size("met") - F.lit(similarity) * F.col("size") + 1e-6) + 1
    cut = ordered.withColumns({"first": F.greatest(first, F.lit(0)).cast("int"), "all": F.size("met")})
    met = cut.select("family", "class", "size", "part", "all", F.posexplode(F.slice("met", F.lit(1), F.col("first"))).alias("at", "met"))
    return met.select("family", "met.shingle", "class", "size", "part", (F.col("all") - F.col("at")).alias("rest"))


def _may_reach(rest: list, sizes: list, similarity: float) -> Column:
    """Whether two sets, of the rests at their first common shingle, can have that similarity."""
    return F.least(*rest) >= F.lit(similarity / (1 + similarity)) * (sizes[0] + sizes[1]) - 1e-6


def _hub_cells(met: DataFrame, turn: int, similarity: float, group: int) -> DataFrame:
    """met: prefixes and root. For each shingle one member, chosen by hash, as a hub, and who may be linked to it and is not yet: cells of up to about group members."""
    hub = F.min(F.struct(F.xxhash64("root", F.lit(turn)).alias("turn"), "class", "size", "rest", "root"))
    hubs = met.groupBy("family", "shingle").agg(hub.alias("hub"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("family", "shingle", "hub")
    may = (F.col("root") != F.col("hub.root")) & _may_reach(["rest", "hub.rest"], [F.col("size"), F.col("hub.size")], similarity)
    pairs = stage(met.join(hubs, ["family", "shingle"]).filter(may).select(F.col("hub.class").alias("family"), F.col("hub.root").alias("_root"), "class", "root").distinct(), f"similar-hubs-{turn}")
    cuts = pairs.groupBy("family", "_root").agg(F.ceil(F.count("*") / group).cast("int").alias("_cuts"))
    members = pairs.join(lightly(cuts.select("family", "_cuts")), "family").withColumn("high", 1 + F.pmod(F.xxhash64("class"), "_cuts").cast("int"))
    centres = cuts.select("family", F.explode(F.sequence(F.lit(1), "_cuts")).alias("high"), F.lit(0).alias("part"), F.col("family").alias("class"), F.col("_root").alias("root"))
    return members.select("family", "high", F.col("high").alias("part"), "class", "root").unionByName(centres).withColumn("low", F.lit(0))


def _met_cells(met: DataFrame, similarity: float) -> DataFrame:
    """met: prefixes and root. The cells (two parts of a family) in which members meet that may be linked and are not yet, with those members alone."""
    # of two sets that may reach the similarity, the smaller one could reach it with one of its own size
    early = F.col("rest") >= F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-6
    groups = met.groupBy("family", "shingle").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.max(early).alias("_early"), F.ceil(F.count("*") / PAIRED).cast("int").alias("cuts"))
    rows = stage(met.join(groups.filter("_a <> _b and _early").select("family", "shingle", "cuts"), ["family", "shingle"]), "similar-met")
    # a shingle that many have is cut by the smaller sets; the larger ones go to each cut
    smaller = rows.filter(early).select("family", "shingle", F.pmod(F.xxhash64("class"), "cuts").cast("int").alias("cut"), *(F.col(c).alias(f"_{c}") for c in ("class", "size", "part", "root", "rest")))
    larger = rows.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    other = (F.col("root") != F.col("_root")) & (F.struct("_size", "_class") < F.struct("size", "class"))
    pairs = larger.join(smaller, ["family", "shingle", "cut"]).filter(other & _may_reach(["rest", "_rest"], [F.col("size"), F.col("_size")], similarity))
    both = F.array(F.struct("part", "class", "root"), F.struct(F.col("_part").alias("part"), F.col("_class").alias("class"), F.col("_root").alias("root")))
    return pairs.select("family", F.least("part", "_part").alias("low"), F.greatest("part", "_part").alias("high"), F.inline(both)).distinct()


def _large_links(large: DataFrame, similarity: float, group: int) -> DataFrame:
    """large: family, class, size, part, shingles. Links (a, b) that connect all members of that similarity: to hubs first, then in the cells that are left."""
    sets = large.select("class", "shingles")
    met = stage(prefixes(large, similarity), "similar-prefixes")
    rooted, found = met.withColumn("root", F.col("class")), None
    for turn in range(HUBS):
        linked = stage(_verified(_hub_cells(rooted, turn, similarity, group).join(sets, "class"), similarity), f"similar-linked-{turn}")
        found = linked if found is None else found.unionByName(linked)
        root = lightly(roots(found, f"similar-rooted-{turn}"))
        rooted = met.join(root, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    return found.unionByName(_verified(_met_cells(rooted, similarity).join(sets, "class"), similarity))


def links(source: DataFrame, classes: DataFrame, other: np.ndarray, words: int, similarity: float, group: int = 1024) -> DataFrame:
    """source: text and at, its key; classes: class, size, at (of one of its texts) and PRINT. Links (a, b) that connect classes as their pairs of that similarity do."""
    if similarity >= 1:
        return source.sparkSession.createDataFrame([], "a long, b long")
    # the smaller of two sets that differ has so many shingles at least: four at 0.8
    wide = classes.filter(F.col("size") >= math.ceil(similarity / (1 - similarity) - 1e-9))
    keyed = wide.select("class", *PRINT).mapInArrow(_keyed(blocks(classes.count(), similarity)), "key long, class long, fp0 long, fp1 long").repartition("key").sortWithinPartitions("key", "class")
    close = stage(keyed.mapInArrow(_close(near(similarity), group), "a long, b long").distinct(), "similar-close")
    found = roots(close, "similar-families")
    family = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).toDF("class", "family")
    members = stage(family.join(classes.select("class", "size", "at"), "class"), "similar-members")
    sets = source.join(lightly(members.select(F.col("at").alias("_at")).distinct()), F.col("at") == F.col("_at"), "left_semi").select("text").mapInArrow(_sets(words, other), "class long, shingles array<long>")
    sets = stage(sets.join(lightly(members.select("class", "family", "size")), "class").dropDuplicates(["class"]), "similar-sets")
    cut = _cut(sets, group)
    small = _verified(cut.filter("parts = 1").withColumns({"low": F.lit(0), "high": F.lit(0), "root": F.col("class")}), similarity)
    large = stage(cut.filter("parts > 1").select("family", "class", "size", "part", "shingles"), "similar-large")
    return small if large.isEmpty() else small.unionByName(_large_links(large, similarity, group))


def judged(docs: DataFrame, words: int, similarity: float, group: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """doc_id, class, root and component_id of each row; and the classes whose hashes met those of others."""
    # a text is found again by its id, or by its own hash where it has none
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("at"))
    described = stage(source.mapInArrow(_described(words), f"doc_id long, at long, class long, second long, size long, {', '.join(f'{c} long' for c in PRINT)}"), "similar-described")
    twice = described.groupBy("class").agg(F.min("second").alias("m"), F.max("second").alias("n")).filter("m <> n")
    other = np.array([r["class"] for r in twice.select("class").collect()], np.int64).view(np.uint64)  # equal hashes of other sets: one in 2**65 pairs
    if len(other):
        described = described.withColumn("class", F.when(F.col("class").isin(other.view(np.int64).tolist()), F.col("second")).otherwise(F.col("class")))
    classes = stage(described.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("at").alias("at"), F.max("size").alias("size"), *(F.max(c).alias(c) for c in PRINT)), "similar-classes")
    root = roots(links(source.select("text", "at"), classes, other, words, similarity, group), "similar")
    rooted = classes.select("class", "least").join(root, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    named = stage(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "root", "component_id"), "similar-components")
    return described.select("doc_id", "class").join(named, "class"), other


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, class and component_id of each row of docs (doc_id, text)."""
    return judged(docs, words, similarity)[0].select("doc_id", "class", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: of its least doc_id (a null id last) and, of rows that repeat that id, the least class and text."""
    found, other = judged(docs, words, similarity)
    name = unused(docs, "_class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _eased(batches):
            own = [classes_of(*shingles(t, words), t.rows, other)[0] for t in texts(_lowered(batch))]
            yield batch.append_column(name, pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64)))

    field = F.lit(0).cast("long").alias(name)
    return one_row_of_each(docs.mapInArrow(run, docs.select("*", field).schema), name, stage(found, "similar-judged")).select(docs.columns)
