"""Operator 4: stupid-backoff language model scores by joins of exploded n-grams with count tables.

Words are lower-cased; every word counts, there is no vocabulary. An n-gram is known by a 64-bit hash of its words. Counts of all n-grams of `order`
words and of their contexts, one word shorter, cover all documents, are aggregated in each task and then by key, and are joined, by the key's
hash, to the n-grams that a document explodes into. A document's score is the sum of its words' log10 scores by its number of words.

A corpus that is scored by its own counts (`score` without a corpus) leaves each text out of the counts that it is scored by: an n-gram that no other text
has is scored one word shorter, times `backoff`, and so on; a word that no other text has counts as if it had been there once. Whether an n-gram backs off is then
told by its key alone (has a second text got it?), so at order 2 one join with the pairs of several texts settles it, and words' counts are those of contexts.
What a text explodes into and the table go to that join in blocks, some numbers of one range of keys each, of which a task takes one range after the other.
A bitmap of fixed size, with two bits for each key that the tables know, keeps most of the n-grams that surely back off out of the shuffle; where it is full,
more rows go on, and results are the same. The most frequent pairs and words, at most `frequent` each, are summed where they are exploded, so they are no hot
keys of the join; other words follow in a second join, by key, once their pair is known to back off or not.

Documents of which the counts know nothing are scored with `corpus`, backing off in the same way. Other orders than 2 and a given corpus
take a join for each length.

Defined results: one row for each doc_id, in which rows that repeat the id are taken together (a null id too), each text left out of the counts for itself alone;
before a text's first word stands a start, counted once for each text with a word; a null or empty text has no words and a null score; a text beside which there are
no words has them all at one of one; an empty table gives no rows, an empty corpus a null score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, mix, pieces, stage, texts
from quillflow.sources.shared import leanly

#: A text's different n-grams and contexts, of so many of which a task adds up the counts at once.
GATHER = 1 << 20
#: Steps in which counts are doubled when the frequent ones are sought.
FINE = 16
#: The bitmap has 2**BITMAP bits (16 MB); it comes to the driver in 2**PART parts.
BITMAP, PART = 27, 8
#: Rows that a task packs at once, into blocks of one of 2**RANGE ranges of keys each; rows of which it adds up the documents at once.
PACK, RANGE, ADD = 1 << 16, 10, 1 << 19
#: The last two bits of a key say what a row is.
NGRAM, CONTEXT, SUM = range(3)
START = np.uint64(0x5BD1E995)
#: The key under which words themselves are counted.
TOTAL = np.uint64(SUM)


def _lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(batch.column("text"))


def _marked(hashes: np.ndarray, kind: int) -> np.ndarray:
    return hashes & ~np.uint64(3) | np.uint64(kind)


class Sequences:
    """The words of a slice's texts behind their starts, as hashes: word i of row r at first[r] + starts + i."""

    def __init__(self, t: Texts, starts: int):
        counts = np.diff(t.word_at)
        self.rows = np.flatnonzero(counts)
        self.counts = counts[self.rows]
        long = self.counts + starts
        self.first = np.cumsum(long) - long
        self.row = np.repeat(self.rows, long)
        self.place = np.arange(long.sum()) - np.repeat(self.first, long)
        self.words = np.full(long.sum(), START, np.uint64)
        self.words[self.place >= starts] = t.hashes()

    def ending(self, n: int) -> np.ndarray:
        """The hash of n words that ends at each place; with fewer before it, of no use."""
        total = mix(self.words + np.uint64(n))
        for back in range(1, n):
            total[back:] = mix(total[back:] * np.uint64(0x9E3779B97F4A7C15) + self.words[:-back])
        return total


def _exploded(t: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each n-gram and each context, that with which a text ends too."""
    s = Sequences(t, order - 1)
    words = s.place >= order - 1
    keys, rows = [_marked(s.ending(order)[words], NGRAM)], [s.row[words]]
    if order > 1:
        context = s.place >= order - 2
        keys.append(_marked(s.ending(order - 1)[context], CONTEXT))
        rows.append(s.row[context])
    return np.concatenate(rows), np.concatenate(keys)


def _in_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A name for each row's own use of a key."""
    return mix(key + mix(row.astype(np.uint64) + np.uint64(1)))


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place, how often its row has its key."""
    _, at, n = np.unique(_in_row(row, key), return_inverse=True, return_counts=True)
    return n[at]


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(n), len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total), pa.array(np.bincount(at, minlength=len(key)))], ["key", "n", "texts"])


def _counted(order: int):
    """Texts to (key, n, texts), pre-aggregated over some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches):
            for t in texts(_lowered(batch)):
                row, key = _exploded(t, order)
                _, first, n = np.unique(_in_row(row, key), return_index=True, return_counts=True)
                held.append((np.append(key[first], TOTAL), np.append(n, len(t.start))))
                size += len(first)
                if size >= GATHER:
                    yield _summed(*zip(*held))
                    held, size = [], 0
        if size:
            yield _summed(*zip(*held))

    return run


def counts(docs: DataFrame, order: int) -> DataFrame:
    """key, c and texts: how often each n-gram of order words, and each context, occurs in docs (text), and in how many texts. TOTAL's c is the number of words."""
    found = docs.select("text").mapInArrow(_counted(order), "key long, n long, texts long")
    return found.groupBy("key").agg(F.sum("n").alias("c"), F.sum("texts").alias("texts"))


def _frequent(table: DataFrame, size: int) -> DataFrame:
    """The rows of the greatest counts, all that share a bin or none, size at most."""
    bin_ = F.floor(F.log2("c") * FINE).cast("int")
    bins = table.groupBy(bin_.alias("bin")).count().collect()  # 64 * FINE rows at most
    least, so_far = 64 * FINE, 0
    for b in sorted(bins, reverse=True):
        so_far += b["count"]
        if so_far > size:
            break
        least = b.bin
    return table.filter(bin_ >= least)


def _slots(key: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and bit of each of a key's two places in a bitmap of 2**size bits."""
    for place in (key >> np.uint64(64 - size), key << np.uint64(size) >> np.uint64(64 - size)):
        yield (place >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)


def _bitmap(table: DataFrame) -> np.ndarray:
    """Two bits for each key; tasks send what they have set in 2**PART parts, which are joined by part."""

    def batch_of(parts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*parts], pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    def setting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << PART, 1 << BITMAP - PART - 3), np.uint8)
        for batch in batches:
            for at, bit in _slots(batch.column("key").to_numpy().view(np.uint64), BITMAP):
                np.bitwise_or.at(out.ravel(), at, bit)
        yield batch_of({int(i): out[i] for i in np.flatnonzero(out.any(axis=1))})

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits")):
                parts[part] = parts.get(part, np.uint8(0)) | np.frombuffer(bits.as_buffer(), np.uint8)
        yield batch_of(parts)

    out = np.zeros((1 << PART, 1 << BITMAP - PART - 3), np.uint8)
    rows = table.select("key").mapInArrow(setting, "part long, bits binary").repartition(1 << PART, "part")
    for r in rows.mapInArrow(joining, "part long, bits binary").collect():  # a row a part
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


class _Known:
    """Counts of some keys, to be looked up by arrays of keys."""

    def __init__(self, table: DataFrame):
        rows = table.select("key", "c").toPandas().sort_values("key")
        self.keys, self.c = rows["key"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The keys' counts, 0 where not known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        keys = keys.view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.c[at], 0)


# Blocks of rows -------------------------------------------------------------------------------------------------------

#: What a block holds: keys and counts of the table, pairs that are kept, or whole rows.
TABLE, KEPT, WHOLE = range(3)
#: A block's numbers, column by column: bytes that vary from row to row apart from those that hardly do, and so shuffle in next to none.
BLOCK = "range int, kind int, key binary, n binary, n_high binary, doc binary, doc_high binary, no_doc binary, fixed binary, rest binary"


def _blocks(kind: int, key: np.ndarray, n: np.ndarray, doc: np.ndarray | None = None, no_doc: np.ndarray | None = None, fixed: np.ndarray | None = None, rest: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (rest: some columns of eight bytes) as a block for each range of keys that they have."""
    of = (key >> np.uint64(64 - RANGE)).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = np.append(first, len(of))

    def cut(x: np.ndarray | None, start: int, end: int) -> pa.Array:
        if x is None:
            return pa.array([b""] * len(first), pa.binary())
        data = np.ascontiguousarray(np.ascontiguousarray(x[order]).view(np.uint8).reshape(len(x), -1)[:, start:end])
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * (end - start)).astype(np.int32)), pa.py_buffer(data)])

    columns = [cut(key, 0, 7), cut(n, 0, 1), cut(n, 1, 8), cut(doc, 0, 2), cut(doc, 2, 8), cut(no_doc, 0, 1), cut(fixed, 0, 5), cut(rest, 0, 8 * REST)]
    return pa.RecordBatch.from_arrays([pa.array(of[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), *columns], [f.split()[0] for f in BLOCK.split(", ")])


class _Rows:
    """The rows of some blocks of one kind."""

    def __init__(self, blocks: pa.RecordBatch, kind: int):
        blocks = blocks.filter(pc.equal(blocks.column("kind"), kind))
        count = pc.binary_length(blocks.column("n")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = int(count.sum())

        def cut(name: str, width: int) -> np.ndarray:
            column = blocks.column(name)
            _, offsets, data = column.cast(pa.binary()).buffers()
            if not self.size or data is None:
                return np.zeros((self.size, width), np.uint8)
            at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, width)

        def joined(*parts: np.ndarray) -> np.ndarray:
            out = np.zeros((self.size, 8), np.uint8)
            at = 0
            for x in parts:
                out[:, at : at + x.shape[1]] = x
                at += x.shape[1]
            return out.view(np.int64).ravel()

        top = np.repeat(blocks.column("range").to_numpy(zero_copy_only=False).astype(np.int64) >> (RANGE - 8), count).astype(np.uint8)
        self.key = joined(cut("key", 7), top[:, None]).view(np.uint64)
        self.n = joined(cut("n", 1), cut("n_high", 7))
        if kind != TABLE:
            self.doc, self.no_doc, self.fixed = joined(cut("doc", 2), cut("doc_high", 6)), cut("no_doc", 1).ravel() > 0, joined(cut("fixed", 5))
            self.rest = np.ascontiguousarray(cut("rest", 8 * REST)).view(np.int64).reshape(-1, REST).T if kind == WHOLE else np.zeros((REST, self.size), np.int64)


def _packed_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64), batch.column("c").to_numpy()))
        size += batch.num_rows
        if size >= PACK:
            yield _blocks(TABLE, *(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield _blocks(TABLE, *(np.concatenate(x) for x in zip(*held)))


#: What a text explodes into. A pair (NGRAM): n times; what each time adds if it backs off (`fixed`, in FIXED parts of one over -OFFSET, five bytes that shuffle well and are
#: exact to 2e-10), and, if not null, the words whose counts its score still needs then (word) or else (context), with the text's own number of them.
#: A word (CONTEXT): n times its logarithm, less own_word. SUM: value, n words, own_word of them backed off.
ROW = "doc_id long, n long, word long, own_word long, context long, own_context long, value double, key long, fixed long"
FIXED, OFFSET = 1 << 32, 64
#: The columns from word to value, which only some rows have; no word's key is 0.
REST = 5


class _Packed:
    """Rows of ROW that wait to be packed."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple]] = {KEPT: [], WHOLE: []}
        self.size = {KEPT: 0, WHOLE: 0}

    def add(self, doc: np.ndarray, no_doc: np.ndarray, n: np.ndarray, *columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        *rest, key, fixed = columns
        kind = KEPT if all(x is None for x in rest) else WHOLE
        fixed = np.zeros(len(key), np.int64) if fixed is None else fixed
        rest = [] if kind == KEPT else [np.stack([np.zeros(len(key), np.int64) if x is None else np.ascontiguousarray(x).view(np.int64) for x in rest], 1)]
        self.held[kind].append((key, n.astype(np.int64), doc, no_doc.astype(np.uint8), fixed, *rest))
        self.size[kind] += len(key)
        if self.size[kind] >= PACK:
            yield from self.out(kind)

    def out(self, kind: int) -> Iterator[pa.RecordBatch]:
        if self.size[kind]:
            yield _blocks(kind, *(np.concatenate(x) for x in zip(*self.held[kind])))
        self.held[kind], self.size[kind] = [], 0


SETTLED = "doc_id long, log double, n_words long, n_backed_off long, word long, own long, times long"


def _summed_up(held: list[tuple]) -> tuple:
    """Documents (id, whether it has none, log, n_words, n_backed_off), each once."""
    doc, no_doc, log, n_words, lost = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, no_doc))
    doc, no_doc = doc[order], no_doc[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (no_doc[1:] != no_doc[:-1])))
    return doc[first], no_doc[first], *(np.add.reduceat(x[order], first) for x in (log, n_words, lost))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of range and kind to what each row comes to (SETTLED): by document, and the words whose counts are still asked for.

    The table's blocks of a range come before its rows, so only the table of the last range has to be kept from batch to batch.
    """
    names = [f.split()[0] for f in SETTLED.split(", ")]
    keys, counts_ = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def ids(doc: np.ndarray, no_doc: np.ndarray) -> pa.Array:
        return pa.array(doc, pa.int64(), mask=no_doc)

    def documents() -> pa.RecordBatch:
        doc, no_doc, log, n_words, lost = _summed_up(held)
        nothing = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([ids(doc, no_doc), pa.array(log), pa.array(n_words), pa.array(lost), nothing, nothing, pa.array(np.zeros(len(doc), np.int64))], names)

    for batch in pieces(batches):
        more = _Rows(batch, TABLE)
        keys, counts_ = np.concatenate([keys, more.key]), np.concatenate([counts_, more.n])
        order = np.argsort(keys)
        keys, counts_ = keys[order], counts_[order]
        for r in (_Rows(batch, KEPT), _Rows(batch, WHOLE)):
            if not r.size:
                continue
            at = np.minimum(np.searchsorted(keys, r.key), max(0, len(keys) - 1))
            there = keys[at] == r.key if len(keys) else np.zeros(r.size, bool)
            c = np.where(there, counts_[at], 1) if len(keys) else np.ones(r.size, np.int64)
            word, own_word, context, own_context, value = r.rest
            kind = r.key & np.uint64(3)
            found, lost, sums = (kind == NGRAM) & there, (kind == NGRAM) & ~there, kind == SUM
            log = r.n * np.select([found, lost], [np.log10(np.maximum(1, c - r.n)), r.fixed / FIXED - OFFSET], np.log10(np.maximum(1, c - own_word)))
            log = np.where(sums, value.view(np.float64), log)
            held.append((r.doc, r.no_doc, log, np.where(sums, r.n, 0), np.where(sums, own_word, np.where(lost, r.n, 0))))
            size += r.size
            asked = np.where(found, context, np.where(lost, word, 0))
            late = np.flatnonzero(asked)
            if len(late):
                nought = pa.array(np.zeros(len(late), np.int64))
                own, times = np.where(found, own_context, own_word)[late], np.where(found, -r.n, r.n)[late]
                yield pa.RecordBatch.from_arrays([ids(r.doc[late], r.no_doc[late]), pa.array(np.zeros(len(late))), nought, nought, pa.array(asked[late]), pa.array(own), pa.array(times)], names)
        if size >= ADD:
            held = [_summed_up(held)]
            size = len(held[0][0])
            if 4 * size >= 3 * ADD:
                yield documents()
                held, size = [], 0
        last = np.uint64(pc.max(batch.column("range")).as_py())
        keep = keys >> np.uint64(64 - RANGE) == last
        keys, counts_ = keys[keep], counts_[keep]
    if size:
        yield documents()
    pa.default_memory_pool().release_unused()


def _pairs(t: Texts, words: _Known, pairs: _Known, seen, total: int, backoff: float) -> Iterator[tuple]:
    """Columns of ROW, of which the first is the row in t, of a slice's texts; None for nulls."""
    s = Sequences(t, 1)
    single = _marked(s.ending(1), CONTEXT)
    own = _own(s.row, single)
    at = np.flatnonzero(s.place >= 1)
    _, first, n = np.unique(_in_row(s.row[at], s.ending(2)[at]), return_index=True, return_counts=True)
    order = np.argsort(first)  # a text's rows together, as they compress better in the shuffle
    at, n = at[first[order]], n[order]
    row, pair = s.row[at], _marked(s.ending(2)[at], NGRAM)
    size = np.diff(t.word_at)
    back = np.log10(backoff) - np.log10(np.maximum(1, total - size))[row]
    # logarithms of words, nan where only the table knows them; a word without a bit is there once, in this text
    c = words.of(single)
    log = np.where(c > 0, np.log10(np.maximum(1, c - own)), np.where(seen(single), np.nan, 0.0))
    word, context = log[at], log[at - 1]
    often = pairs.of(pair)
    sure = ~seen(pair)
    sent = ~sure & (often == 0)
    kept = sent & ~np.isnan(word) & ~np.isnan(context)
    value = np.select([sure, sent & ~kept, sent], [back + np.nan_to_num(word), 0.0, -context], np.log10(np.maximum(1, often - n)) - np.nan_to_num(context))
    sums = _marked(mix(np.arange(t.rows, dtype=np.uint64) + np.uint64(t.at[-1]) * np.uint64(0x9E3779B9)), SUM)
    yield np.arange(t.rows), size, None, np.bincount(row[sure], n[sure], t.rows).astype(np.int64), None, None, np.bincount(row, n * value, t.rows), sums, None
    # pairs that the table decides: if they back off, what has been added for them is taken back
    fixed = np.rint((back + np.where(kept, word + context, 0.0) + OFFSET) * FIXED).astype(np.int64)
    yield row[kept], n[kept], None, None, None, None, None, pair[kept], fixed[kept]
    open_ = sent & ~kept
    yield row[open_], n[open_], single[at[open_]], own[at[open_]], single[at[open_] - 1], own[at[open_] - 1], None, pair[open_], fixed[open_]
    # words of which the pair is decided, but not the count
    plus, minus = sure & np.isnan(word), ~sure & (often > 0) & np.isnan(context)
    place, times = np.concatenate([at[plus], at[minus] - 1]), np.concatenate([n[plus], -n[minus]])
    _, first, of = np.unique(_in_row(s.row[place], single[place]), return_index=True, return_inverse=True)
    times, place = np.bincount(of, times, len(first)).astype(np.int64), place[first]
    yield s.row[place], times, None, own[place], None, None, None, single[place], None


def score_by_own(docs: DataFrame, backoff: float, frequent: int) -> DataFrame:
    """doc_id, n_words, n_backed_off and log, the sum of the words' log10 scores of order 2, by the counts of docs' other texts."""
    kind = F.col("key").bitwiseAND(3)
    with leanly(docs.sparkSession):
        table = stage(counts(docs, 2).filter(((kind == NGRAM) & (F.col("texts") > 1)) | ((kind == CONTEXT) & (F.col("c") > 1)) | (F.col("key") == int(TOTAL))).select("key", "c"), "lm-counts")
        total = table.filter(F.col("key") == int(TOTAL)).agg(F.sum("c")).first()[0] or 0
        sent = docs.sparkSession.sparkContext.broadcast((*(_Known(_frequent(table.filter(kind == k), frequent)) for k in (CONTEXT, NGRAM)), _bitmap(table)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, bits = sent.value
        packed = _Packed()

        def seen(key: np.ndarray) -> np.ndarray:
            return np.logical_and.reduce([bits[at] & bit > 0 for at, bit in _slots(key, BITMAP)])

        for batch in pieces(batches):
            ids = batch.column("doc_id")
            doc, no_doc = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            for t in texts(_lowered(batch)):
                for row, *columns in _pairs(t, words, pairs, seen, total, backoff):
                    yield from packed.add(doc[row + t.first], no_doc[row + t.first], *columns)
        for k in (KEPT, WHOLE):
            yield from packed.out(k)
        pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", "text").mapInArrow(explode, BLOCK).unionByName(table.mapInArrow(_packed_table, BLOCK))
    settled = rows.repartition("range").sortWithinPartitions("range", "kind").mapInArrow(_settled, SETTLED)
    # the words of decided pairs that are not frequent: few, by key
    sums = [F.sum(x).alias(x) for x in ("log", "n_words", "n_backed_off")]
    with leanly(docs.sparkSession):
        part = stage(settled.groupBy("doc_id", "word", "own").agg(*sums, F.sum("times").alias("times")), "lm-parts")
    late = part.filter("word is not null").join(table.filter(kind == CONTEXT).select(F.col("key").alias("word"), "c"), "word", "left")
    late = late.select("doc_id", (F.col("times") * F.log10(F.greatest(F.lit(1), F.coalesce("c", F.lit(1)) - F.col("own")))).alias("log"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_backed_off"))
    return part.select(late.columns).unionByName(late).groupBy("doc_id").agg(*sums)


def score_by_corpus(docs: DataFrame, corpus: DataFrame, order: int, backoff: float, own: bool = False) -> DataFrame:
    """doc_id, n_words, n_backed_off and log of docs by the counts of corpus (text), with backoff; own: corpus is docs, and each text is left out of its counts."""
    tables = {k: stage(counts(corpus, k).select("key", "c"), f"lm-{k}-grams") for k in range(1, order + 1)}
    total = tables[1].filter(F.col("key") == int(TOTAL)).agg(F.sum("c")).first()[0]
    names = [f"{kind}{k}" for k in range(order, 0, -1) for kind in ("gram", "context")][:-1]
    columns = [*names, *(f"own_{n}" for n in names), "size"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a word: the n-grams that end there, of each length, and their contexts; the text's own number of each, and of words."""
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            for t in texts(_lowered(batch)):
                found, mine = [], []
                for k in range(order, 0, -1):
                    s = Sequences(t, k - 1)
                    at = np.flatnonzero(s.place >= k - 1)
                    found.append(_marked(s.ending(k)[at], NGRAM))
                    mine.append(_own(s.row[at], found[-1]))
                    if k > 1:
                        whole = np.flatnonzero(s.place >= k - 2)
                        times = np.zeros(len(s.place), np.int64)
                        times[whole] = _own(s.row[whole], s.ending(k - 1)[whole])
                        found.append(_marked(s.ending(k - 1)[at - 1], CONTEXT))
                        mine.append(times[at - 1])
                row = t.row_of_word()
                mine = [x if own else np.zeros(len(row), np.int64) for x in (*mine, np.diff(t.word_at)[row])]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + t.first)), *(pa.array(c.view(np.int64)) for c in (*found, *mine))], ["doc_id", *columns])

    rows = docs.select("doc_id", "text").mapInArrow(explode, f"doc_id long, {', '.join(f'{n} long' for n in columns)}").groupBy("doc_id", *columns).agg(F.count("*").alias("n"))
    rows = rows.withColumns({"log": F.lit(None).cast("double"), "n_backed_off": F.lit(0).cast("long")})
    for k in range(order, 0, -1):
        for name in (n for n in names if n[-1] == str(k)):
            rows = rows.join(tables[k].select(F.col("key").alias(name), F.col("c").alias(f"c_{name}")), name, "left")
        whole = F.col(f"c_context{k}") - F.col(f"own_context{k}") if k > 1 else F.greatest(F.lit(1), F.lit(total) - F.col("size")) if total else F.lit(None)
        count = F.coalesce(f"c_gram{k}", F.lit(0)) - F.col(f"own_gram{k}")
        found = F.when(count > 0, count) if k > 1 else F.greatest(F.lit(1), count)
        log = F.coalesce("log", F.log10(found / whole) + F.log10(F.lit(backoff)) * (order - k))
        rows = rows.withColumns({"log": log, "n_backed_off": F.when((F.lit(k) == order) & log.isNull(), F.col("n")).otherwise(F.col("n_backed_off"))})
    scored = rows.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("n_backed_off").alias("n_backed_off"), F.sum(F.col("n") * F.col("log")).alias("log"))
    ids = docs.select("doc_id").distinct()
    return ids.join(scored, ids.doc_id.eqNullSafe(scored.doc_id), "left").select(ids.doc_id, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_backed_off")), "log")


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = 2, backoff: float = 0.4, frequent: int = 1 << 17) -> DataFrame:
    """doc_id, n_words, score (mean of the words' log10 stupid-backoff scores) and n_backed_off (words scored by fewer than order words) for docs (doc_id, text), by the
    counts of corpus (text), or of docs themselves without the text that is scored."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if corpus is None and order == 2:
        found = score_by_own(docs, backoff, frequent)
    else:
        found = score_by_corpus(docs, docs if corpus is None else corpus, order, backoff, corpus is None)
    return found.select("doc_id", "n_words", (F.col("log") / F.nullif("n_words", F.lit(0))).alias("score"), "n_backed_off")
