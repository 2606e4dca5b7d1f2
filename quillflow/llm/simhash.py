"""Operator 6: near-duplicates by SimHash, found by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words and shingles (repeats count; a text of fewer words is one shingle; none: fingerprint zero). A bit of
the 64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes. Fingerprints link at most `bits` differing bits.

Only different fingerprints are compared; copies ride along. Each is put into one table for every choice of KEPT of the BLOCKS blocks of bits:
two fingerprints that differ in up to BLOCKS - KEPT bits agree in all the blocks of some choice. Those that share a table's key are verified
within the key's group by Hamming distance, which yields links that span the group's close ones, not all pairs. A group of over `group`
fingerprints is not compared pairwise: the bits that its key leaves open are cut into blocks in the same way, for tables with half as many open
bits. Should a group there be as large again, each member is listed under the words at one and two flipped bits of what the key leaves open;
members that meet there, one of them within one bit, are within three bits of each other, and the least such near member links the others.

Defined results: null and empty texts have fingerprint zero and link like any other; rows that repeat are one class; the component id is the
least doc_id reachable, null ids left out (null if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, stage, texts, unused
from quillflow.llm.components import one_row_of_each, roots
from quillflow.llm.xxh import xxh64

SEED = 42
BLOCKS, KEPT = 6, 3
#: Shingles that are hashed at once.
AT_ONCE = 1 << 15


def _masks(bits: list[int]) -> list[int]:
    """A mask for each choice of KEPT of the BLOCKS blocks into which these bits are cut."""
    cuts = [len(bits) * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [sum(1 << x for x in bits[i:j]) for i, j in itertools.pairwise(cuts)]
    return [sum(choice) for choice in itertools.combinations(blocks, KEPT)]


#: What the tables' keys keep of a fingerprint, and for each of these tables, what its finer tables keep.
MASKS = _masks([*range(64)])
FINER = [[m | x for x in _masks([i for i in range(64) if not m >> i & 1])] for m in MASKS]


def prints(t: Texts, words: int) -> np.ndarray:
    """The SimHash of each text, as an unsigned number."""
    count, size = np.diff(t.word_at), t.end - t.start
    # words with one space behind each
    at = np.cumsum(size + 1) - (size + 1)
    number = np.repeat(np.arange(len(size)), size)
    line = np.full(int((size + 1).sum()), 32, np.uint8)
    line[np.arange(len(number)) + number] = t.data[np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(t.start, size)]
    n = np.where(count > 0, np.maximum(1, count - words + 1), 0)
    row = np.repeat(np.arange(t.rows), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + t.word_at[row]
    last = np.minimum(first + words, t.word_at[row + 1]) - 1
    counts = np.zeros((t.rows, 64), np.int64)
    for s in range(0, len(row), AT_ONCE):
        some, begin, end = row[s : s + AT_ONCE], at[first[s : s + AT_ONCE]], (at + size)[last[s : s + AT_ONCE]]
        bits = np.unpackbits(xxh64(line, begin, end, SEED).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(some, prepend=-1))
        counts[some[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, name: str, words: int) -> DataFrame:
    """docs with the fingerprint of the text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prints(t, words) for t in texts(pc.ascii_lower(batch.column(batch.schema.get_field_index("text"))))]
            yield batch.append_column(name, pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)))

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    return with_fingerprint(docs.select("doc_id", "text"), "fp", words).select("doc_id", "fp")


def _spanning(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever of fps is connected by steps of up to bits differing bits."""
    left, out = np.ones(len(fps), bool), []
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        todo = [first]
        while todo:
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[todo.pop()]) <= bits))
            left[near] = False
            todo += near.tolist()
            out += [(i, first) for i in near.tolist()]
    return out


def links(fps: DataFrame, bits: int = 3, group: int = 2048) -> DataFrame:
    """fps: fp, all different. Links (a, b) that connect all fingerprints with paths of links of up to bits bits; bits is at most BLOCKS - KEPT."""
    if bits > BLOCKS - KEPT:
        raise ValueError(f"at most {BLOCKS - KEPT} bits")
    kept = lambda masks: F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: F.col("fp").bitwiseAND(m))
    near, over = _within_groups(fps.select("fp", F.posexplode(kept(MASKS)).alias("t", "key")), bits, group)
    if over.isEmpty():
        return near
    finer = F.array(*[kept(masks) for masks in FINER])[F.col("t")]
    opened = over.select("t", "fp", F.posexplode(finer).alias("n", "key")).select((F.col("t") * len(FINER[0]) + F.col("n")).alias("t"), "key", "fp")
    nearer, rest = _within_groups(opened, bits, group)
    near = near.unionByName(nearer)
    return near if rest.isEmpty() else near.unionByName(_links_by_flips(rest, bits))


def _within_groups(keyed: DataFrame, bits: int, group: int) -> tuple[DataFrame, DataFrame]:
    """keyed: t, key, fp. Links (a, b) within the groups of a key, and the members (t, fp) of groups that are too large."""
    keyed = keyed.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (t, a, b): a link where t is null; a member a of a group that is too large where b is null."""
        none = np.zeros(0, np.int64)
        held, large = (none, none, none), None  # rows of the last key so far; the key of a large group that is under way

        def groups(t: np.ndarray, key: np.ndarray, fp: np.ndarray, ended: bool):
            nonlocal held, large
            t, key, fp = (np.concatenate(x) for x in zip(held, (t, key, fp)))
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])) if len(t) else none
            bounds = np.append(new, len(t))
            sizes = np.diff(bounds)
            a, b, which = [], [], []
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) * (large is not None)).tolist():
                s, e = int(bounds[g]), int(bounds[g + 1])
                last = g == len(sizes) - 1 and not ended
                if large == (t[s], key[s]) or e - s > group:
                    a += fp[s:e].tolist()
                    b += [None] * (e - s)
                    which += t[s:e].tolist()
                    large = (t[s], key[s])
                elif not last:
                    for i, j in _spanning(fp[s:e].view(np.uint64), bits):
                        a.append(int(fp[s + i]))
                        b.append(int(fp[s + j]))
                        which.append(None)
            if len(sizes) and not ended:
                s = int(bounds[-2])
                sent = large == (t[s], key[s])
                held = (none, none, none) if sent else (t[s:], key[s:], fp[s:])
            else:
                held = (none, none, none)
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["t", "a", "b"])

        for batch in batches:
            yield groups(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "fp")), False)
        yield groups(none, none, none, True)

    found = stage(keyed.mapInArrow(compare, "t int, a long, b long"), "simhash-links")
    return found.filter("t is null").select("a", "b"), found.filter("t is not null").select("t", F.col("a").alias("fp"))


def _links_by_flips(members: DataFrame, bits: int) -> DataFrame:
    """Links within large groups: members (t, fp) of the finer table t; those that share t's key differ only in the bits that t leaves open."""
    words = {}
    for t, mask in enumerate(m for masks in FINER for m in masks):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        near = [0, *free] if bits > 1 else [0]
        far = [x | y for x, y in itertools.combinations(free, 2)] if bits > 2 else free if bits == 1 else []
        words[t] = (np.array(near + far, np.uint64), len(near))

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "fp"))
            for t in np.unique(ts).tolist():
                flips, n_near = words[t]
                own = fps[ts == t]
                for at in range(0, len(own), 512):
                    some = own[at : at + 512]
                    n = len(some) * len(flips)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array((some.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(some, len(flips))), pa.array(np.tile(np.arange(len(flips)) < n_near, len(some)))], ["t", "word", "fp", "near"])

    listed = members.mapInArrow(flip, "t int, word long, fp long, near boolean")
    hubs = listed.groupBy("t", "word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).filter("hub is not null and n > 1").drop("n")
    return listed.join(hubs, ["t", "word"]).filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _judged(docs: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and fp of each row, and fp, root and component_id of each fingerprint."""
    found = stage(fingerprints(docs, words), "simhash-fingerprints")
    classes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    root = roots(links(classes.select("fp"), bits), "simhash")
    rooted = classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found, stage(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text)."""
    found, named = _judged(docs, words, bits)
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each component: of its least doc_id (a null id last) and, of rows that repeat that id, the least fingerprint and text."""
    found, named = _judged(docs, words, bits)
    name = unused(docs, "_class")
    judged = stage(found.join(named, "fp").select("doc_id", F.col("fp").alias("class"), "root"), "simhash-judged")
    return one_row_of_each(with_fingerprint(docs, name, words), name, judged).select(docs.columns)
