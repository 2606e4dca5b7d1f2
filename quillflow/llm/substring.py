"""Operator 8: cut passages that repeat from documents of smaller ids, by seed and extend over winnowed anchors.

A window is `length` consecutive words. Winnowing names in each window its leftmost least `seed`-word gram: the anchor. Windows of equal words
name the same anchor at the same place, so every repeat of a whole window shares an anchor, and neighbouring windows share theirs: they form
a run. Documents join on anchors; a run is extended both ways to all the words of its windows. Where that extended run is also in a document
of smaller id, the whole run repeats at once. Runs that meet at an anchor but differ in their extension (at the edges of a passage, or where a
copy was changed) are compared window by window. What repeats is merged to maximal spans, none shorter than a window.

No group is expanded into pairs: in an order by (anchor, extension, doc_id) each row is held against the first of its extension, and only firsts
go on to the comparison of windows. Copies that meet in one task are settled before the shuffle, so a passage that a third of all
documents share arrives as a row a task, and sorted groups are streamed, never collected.

Defined results: null and empty texts have no words; a text of fewer words than a window repeats nothing; rows of one doc_id, also with other
texts, do not cut each other; a row with a null doc_id is kept whole and cuts nothing; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, grams, mix, stage, texts, word_ranges

#: Rows that a task gathers before it settles copies among them.
GATHER = 1 << 20
#: A row's place: its text's checksum, its first window's first word, and its windows less one.
SUM_BITS, START_BITS, COUNT_BITS = 28, 31, 4
ROW = "anchor long, ext long, doc_id long, place long, settled boolean"


def _sum(text: bytes) -> int:
    return zlib.crc32(text) & (1 << SUM_BITS) - 1


def _rows(anchor: np.ndarray, ext: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of a task, with what repeats a smaller document of the same task settled and spread over partitions."""
    order = np.lexsort((doc, ext, anchor))
    anchor, ext, doc, place = anchor[order], ext[order], doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (ext[1:] != ext[:-1])
    settled = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else new
    spread = mix((doc * 31 + place).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.where(settled, spread, anchor)), pa.array(np.where(settled, 0, ext)), pa.array(doc), pa.array(place), pa.array(settled)], ["anchor", "ext", "doc_id", "place", "settled"])


def _gather(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GATHER:
            yield _rows(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _rows(*map(np.concatenate, zip(*held)))


def runs(t: Texts, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, extension, first window (a word's number in the slice) and windows of each run."""
    words, wide = t.hashes(), length - seed + 1
    starts = np.flatnonzero(np.arange(len(words)) + length <= t.ends())
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    gram = grams(words, seed)
    anchor = starts + sliding_window_view(gram, wide).argmin(axis=1)[starts]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, count = starts[new], np.diff(np.append(new, len(anchor)))
    ext = word_ranges(words, first, first + count + length - 1)
    return gram[anchor[new]].view(np.int64), ext.view(np.int64), first, count


def _seeds(length: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for t in texts(batch.column("text")):
                    anchor, ext, first, count = runs(t, length, seed)
                    sums = np.array([_sum(t.data[a:b]) for a, b in zip(t.at[:-1], t.at[1:])], np.int64)
                    row = t.row_of_word()[first]
                    yield anchor, ext, ids[t.first + row], sums[row] << START_BITS + COUNT_BITS | first - t.word_at[row] << COUNT_BITS | count - 1

        yield from _gather(parts())

    return run


def _windows(length: int) -> Callable:
    """Each window of the runs listed with a text, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                ids, sums = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "sum"))
                lists = batch.column("runs")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                for t in texts(batch.column("text")):
                    rows = np.arange(t.rows)
                    runs_at = at[t.first : t.first + t.rows + 1]
                    row = np.repeat(rows, np.diff(runs_at))
                    listed = flat[runs_at[0] : runs_at[-1]]
                    n = (listed & (1 << COUNT_BITS) - 1) + 1
                    row, start = np.repeat(row, n), np.repeat(listed >> COUNT_BITS, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    begin = t.word_at[row] + start
                    key = word_ranges(t.hashes(), begin, begin + length).view(np.int64)
                    yield key, np.zeros(len(key), np.int64), ids[t.first + row], sums[t.first + row] << START_BITS + COUNT_BITS | start << COUNT_BITS

        yield from _gather(parts())

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, ext, doc_id) to (doc_id, place, repeats): those that a smaller document has, and firsts that must be compared further.

    Held from batch to batch: the last group's anchor, extension, first document and number of extensions, and its first document's rows while there
    is one extension only.
    """
    anchor = ext = first = None
    kinds, pending = 0, []

    def out(doc: list[np.ndarray], place: list[np.ndarray], repeats: list[bool]) -> pa.RecordBatch:
        flags = np.repeat(np.array(repeats, bool), [len(x) for x in doc])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(place)), pa.array(flags)], ["doc_id", "place", "repeats"])

    for batch in batches:
        a, e, d, p, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "ext", "doc_id", "place", "settled"))
        docs, places, repeats = [d[s]], [p[s]], [True]
        a, e, d, p = a[~s], e[~s], d[~s], p[~s]
        if len(a):
            same_group = anchor is not None and a[0] == anchor
            same_kind = same_group and e[0] == ext
            new_group = np.concatenate([[not same_group], a[1:] != a[:-1]])
            new_kind = np.concatenate([[not same_kind], (a[1:] != a[:-1]) | (e[1:] != e[:-1])])
            if not same_group:
                kinds, pending = 0, []
            # group 0 is the one held, if it goes on
            group = np.cumsum(new_group) - (0 if same_group else 1)
            n_kinds = np.bincount(group, weights=new_kind).astype(np.int64)
            n_kinds[0] += kinds if same_group else 0
            kind = np.cumsum(new_kind)
            firsts = np.concatenate([[first if same_kind else 0], d[new_kind]])
            mine = firsts[kind]
            later = d > mine
            docs.append(d[later]), places.append(p[later]), repeats.append(True)
            go_on = ~later & (n_kinds[group] > 1)
            docs.append(d[go_on]), places.append(p[go_on]), repeats.append(False)
            if pending and n_kinds[0] > 1:
                for x, y in pending:
                    docs.append(x), places.append(y), repeats.append(False)
            last = group == group[-1]
            if group[-1] > 0 or n_kinds[0] > 1:
                pending = []
            if n_kinds[-1] == 1:
                pending.append((d[last & ~later], p[last & ~later]))
            anchor, ext, first, kinds = a[-1], e[-1], mine[-1], int(n_kinds[-1])
        yield out(docs, places, repeats)


def _judged(rows: DataFrame, name: str) -> DataFrame:
    sorted_rows = rows.repartition("anchor").sortWithinPartitions("anchor", "ext", "doc_id")
    return stage(sorted_rows.mapInArrow(_judge, "doc_id long, place long, repeats boolean"), name)


def _listed(rows: DataFrame) -> DataFrame:
    """_id, _sum, runs: places of one document together, as many at most as it has words."""
    low = START_BITS + COUNT_BITS
    return rows.groupBy(F.col("doc_id").alias("_id"), F.shiftright("place", low).alias("_sum")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << low) - 1))).alias("runs"))


def repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """_id, _sum (of the text), runs: the repeated windows of each document that has any, as start << COUNT_BITS | windows - 1."""
    if not 0 <= length - seed < 1 << COUNT_BITS or seed < 1:
        raise ValueError(f"seed must be at least 1 and fewer than {1 << COUNT_BITS} words shorter than length")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    met = _judged(source.mapInArrow(_seeds(length, seed), ROW), "substring-runs")
    open_runs = _listed(met.filter("not repeats"))
    summed = source.withColumn("sum", F.crc32("text").bitwiseAND(F.lit((1 << SUM_BITS) - 1)))
    beside = summed.join(open_runs, (F.col("doc_id") == F.col("_id")) & (F.col("sum") == F.col("_sum"))).select("doc_id", "sum", "text", "runs")
    compared = _judged(beside.mapInArrow(_windows(length), ROW), "substring-windows")
    return _listed(met.unionByName(compared).filter("repeats"))


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, listed in zip(batch.column("text"), batch.column("runs").to_pylist()):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for at in listed or ():
                    start = at >> COUNT_BITS
                    gone[start] += 1
                    gone[start + (at & (1 << COUNT_BITS) - 1) + length] -= 1
                cut = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))).reshape(-1, 2)
                n_words.append(len(words))
                n_removed.append(int(cut.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                kept.append(b" ".join(words if not listed else [words[i] for i in np.flatnonzero(~cut)]).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, length: int = 13, seed: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal repeats, as word numbers from start to before end) and kept (the words left, joined by a space) of each row."""
    found = repeats(docs, length, seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("sum", F.crc32("text").bitwiseAND(F.lit((1 << SUM_BITS) - 1)))
    with_runs = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("sum") == F.col("_sum")), "left").select("doc_id", "text", "runs")
    return with_runs.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
