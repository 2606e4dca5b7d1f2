"""Operator 3: find benchmark items in documents by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are lower-cased and read as words of letters and digits; an item is in a document if some stretch of it is within (1 - similarity) of the item's
words of edits (words put in, left out or replaced). The CGK embedding walks along a word sequence: step j reads the word it stands on and moves on if that
word's random bit for step j is 1, so two sequences of small edit distance have walks of small Hamming distance. Walks are sampled at a few steps each,
and windows that agree in all steps of a sample are candidates.

Samples are of two kinds. Those of the first kind take their places from the whole walk of a window as long as the item: items are grouped by their words,
and a walk takes twice as many steps as its group has words at least. Edits at the limit, spread evenly, leave between them runs of a few words
only (`run`), after which walks may part for long; so samples of the second kind take theirs from the steps of one run, and are used where they read as
many different words as they have places. Every word of an item starts a window, so long items have windows all along, and documents have one
at every word or every `stride` of them. The tests measure recall at the limit, for items of 1 to 300 words and edits of all kinds, at 0.95 or more.

A candidate is judged on the item-sized stretch around it: first by how many of its words the item has, which edits within the limit cannot take away, then by
the exact edit distance. The law is one for items of all sizes; below five words it leaves no edit at a similarity of 0.8.

Documents are scanned where they lie; items are taken in blocks of about `block` words, whose signatures go along with the task, so nothing is
shuffled and no passage, however common, meets in one task.

Defined results: null and empty texts contain nothing; items without a word are in no document; an item without an id is sought like any other; rows
that repeat are judged each on its own; an empty benchmark finds nothing; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, mix, pieces, texts

#: ASCII bytes between words; other letters' bytes belong to words.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Least words of the size groups, by which whole windows are as long as items; of shorter items every word is in a run.
GROUPS = (12, 20, 36)
#: Places of a sample of a whole window, such samples a group, and words between the windows of documents.
PLACES, WHOLE, WHOLE_STRIDE = 4, 4, 8
#: By words of a run (a longer one counts as the last): steps of its samples, one each for every walk, and words between the windows of documents.
WALKS = 4
RUNS = {1: ([(0,)], 1), 2: ([(0, 1), (0, 2)], 1), 3: ([(0, 1, 2), (0, 2, 4)], 1), 4: ([(0, 2, 4), (0, 3, 5)], 2)}
#: Bits of a signature that find its place in a bitmap: at least, and beyond those of the number of signatures.
BITMAP, SPARE = 20, 4
SEED = 7


def _allowed(words: int, similarity: float) -> int:
    return math.floor((1 - similarity) * words + 1e-9)


def run(words: int, similarity: float) -> int:
    """Words of the longest stretch that any edits within the limit leave whole."""
    edits = _allowed(words, similarity)
    return -(-(words - edits) // (edits + 1))


@dataclass(frozen=True)
class Sample:
    """Steps of a walk that are compared; for items of runs of so many words, or (run 0) of least words; and from which words of a document on."""

    number: int
    run: int
    least: int
    walk: int
    places: tuple[int, ...]
    stride: int

    def serves(self, words: np.ndarray, similarity: float) -> np.ndarray:
        """Which items, by their number of words, the sample is for."""
        if self.run:
            # of an item that allows no edit, any three words in a row will do
            return np.array([min(max(RUNS) if _allowed(n, similarity) else 3, run(n, similarity)) if n else 0 for n in words.tolist()], np.int64) == self.run
        return (words > 0) & (np.searchsorted(GROUPS, words, "right") - 1 == GROUPS.index(self.least))


def samples() -> list[Sample]:
    rng, out = np.random.default_rng(SEED), []
    for words, (kinds, stride) in RUNS.items():
        out += [(words, 0, walk, places, stride) for places in kinds for walk in range(WALKS if words > 1 else 1)]
    for least in GROUPS:
        out += [(0, least, i % 2, tuple(sorted(rng.choice(2 * least, PLACES, replace=False).tolist())), WHOLE_STRIDE) for i in range(WHOLE)]
    return [Sample(n, *x) for n, x in enumerate(out)]


@dataclass
class Items:
    """A block of items with their signatures."""

    ids: list[int | None]
    similarity: float
    samples: list[Sample]
    #: All items' words by their hashes, where each item's begin, and (item, word) pairs in order.
    words: np.ndarray
    first: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: By sample: sorted signatures with item and place in it, and a bitmap of them.
    signatures: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    bitmaps: dict[int, np.ndarray] = field(default_factory=dict)


def _walk(words: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings (a row a step) of the sequences from starts on, and the last step's place; words must go on for steps words after each start."""
    symbols = mix(words ^ np.uint64((walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    at, out = starts.copy(), np.empty((steps, len(starts)), np.uint64)
    for j in range(steps):
        if j:
            at += (now >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64)
        out[j] = now = symbols[at]
    return out, at - starts


def _signature(walk: np.ndarray, sample: Sample) -> np.ndarray:
    total = np.full(walk.shape[1], sample.number + 1, np.uint64)
    for p in sample.places:
        total = (total ^ walk[p]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _padded(words: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of some texts, with pad empty words after each, and where each text's words begin there."""
    first = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.zeros(first[-1], np.uint64)
    out[np.arange(len(words)) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)] = words
    return out, first


def _walks(padded: np.ndarray, first: np.ndarray, counts: np.ndarray, chosen: list[Sample]) -> Iterator[tuple[list[Sample], np.ndarray, np.ndarray, np.ndarray]]:
    """By walk and stride: its samples, row and place of each window, and the embeddings."""
    for walk, stride in sorted({(s.walk, s.stride) for s in chosen}):
        own = [s for s in chosen if (s.walk, s.stride) == (walk, stride)]
        n = -(-counts // stride)
        row = np.repeat(np.arange(len(counts)), n)
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
        yield own, row, place, _walk(padded, first[row] + place, walk, max(s.places[-1] for s in own) + 1)[0]


def _pair(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(words + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def prepare(rows: list[tuple[int | None, str | None]], similarity: float) -> Items:
    """The items (id, text) of a block, made ready to be met."""
    chosen = samples()
    column = pa.array([x or "" for _, x in rows], pa.string())
    parts = [(t.hashes(), np.diff(t.word_at)) for t in texts(pc.utf8_lower(column), space=BREAK)]
    words, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    items = Items([i for i, _ in rows], similarity, chosen, words, np.concatenate([[0], np.cumsum(counts)]))
    items.pairs = np.unique(_pair(np.repeat(np.arange(len(counts)), counts), words))
    padded, first = _padded(words, counts, 2 * GROUPS[-1])
    for sample in chosen:
        at = np.flatnonzero(sample.serves(counts, similarity))
        if not len(at):
            continue
        place, of = _ranges(np.zeros(len(at), np.int64), counts[at])
        item = at[of]
        walk, _ = _walk(padded, first[item] + place, sample.walk, sample.places[-1] + 1)
        # how far each place is from the start: what the item has no word for is of no use, nor a run's sample that reads a word twice,
        # but for the first walk's where no edit is allowed
        far = [_walk(padded, first[item] + place, sample.walk, p + 1)[1] for p in sample.places]
        fits = place + far[-1] < counts[item]
        free = (sample.run == 0) | (sample.walk == 0) & (np.array([_allowed(n, similarity) for n in counts.tolist()])[item] == 0)
        for one, two in zip(far, far[1:]):
            fits &= free | (one < two)
        sig = _signature(walk, sample)[fits]
        order = np.argsort(sig)
        items.signatures[sample.number] = sig[order], item[fits][order], place[fits][order]
        bits = max(BITMAP, len(sig).bit_length() + SPARE)
        items.bitmaps[sample.number] = np.zeros(1 << bits, bool)
        items.bitmaps[sample.number][(sig >> np.uint64(64 - bits)).astype(np.int64)] = True
    return items


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, with the number of the range."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def _candidates(padded: np.ndarray, first: np.ndarray, counts: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, and the word of the row at which the item may begin."""
    found = [(np.zeros(0, np.int64),) * 3]
    for own, row, place, walk in _walks(padded, first, counts, [s for s in items.samples if s.number in items.signatures]):
        for sample in own:
            sigs, item, at = items.signatures[sample.number]
            bitmap = items.bitmaps[sample.number]
            sig = _signature(walk, sample)
            maybe = np.flatnonzero(bitmap[(sig >> np.uint64(65 - len(bitmap).bit_length())).astype(np.int64)])
            hit, of = _ranges(*(np.searchsorted(sigs, sig[maybe], side) for side in ("left", "right")))
            found.append((row[maybe[of]], item[hit], place[maybe[of]] - at[hit]))
    rows, item, begin = (np.concatenate(x) for x in zip(*found))
    if not len(rows):
        return rows, item, begin
    order = np.lexsort((begin, item, rows))
    rows, item, begin = rows[order], item[order], begin[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1])])
    return rows[new], item[new], begin[new]


def edit_distance_within(item: np.ndarray, region: np.ndarray, limit: int | None = None) -> int:
    """The least number of edits between item and any stretch of region (arrays of words); if it is over limit, some number over limit."""
    ramp = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item.tolist()):
        nxt = np.empty_like(row)
        nxt[0] = i + 1
        np.minimum(row[:-1] + (region != c), row[1:] + 1, out=nxt[1:])
        row = np.minimum.accumulate(nxt - ramp) + ramp
        if limit is not None and i % 8 == 7 and (least := int(row.min())) > limit:
            return least
    return int(row.min())


def meet(t: Texts, items: Items) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, edit distance, similarity) of each verified pair; item is its number in the block."""
    words, counts = t.hashes(), np.diff(t.word_at)
    padded, first = _padded(words, counts, 2 * GROUPS[-1])
    row, item, begin = _candidates(padded, first, counts, items)
    size = np.diff(items.first)[item]
    edits = np.floor((1 - items.similarity) * size + 1e-9).astype(np.int64)
    low, high = np.maximum(begin - edits, 0), np.minimum(begin + size + edits, counts[row])
    keep = high - low >= size - edits
    row, item, low, high, size, edits = (x[keep] for x in (row, item, low, high, size, edits))
    good = np.zeros(len(row), bool)
    for at in range(0, len(row), 1 << 14):
        part = slice(at, at + (1 << 14))
        place, of = _ranges(low[part], high[part])
        pair = _pair(item[part][of], words[t.word_at[row[part][of]] + place])
        known = items.pairs[np.minimum(np.searchsorted(items.pairs, pair), len(items.pairs) - 1)] == pair
        good[part] = np.bincount(of[known], minlength=len(low[part])) >= (size - edits)[part]
    row, item, low, high, edits = (x[good] for x in (row, item, low, high, edits))
    # candidates of a pair come in order: stretches that overlap are one
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    at = np.flatnonzero(new)
    best: dict[tuple[int, int], int] = {}
    for r, i, s, e, n in zip(*(x.tolist() for x in (row[at], item[at], low[at], np.maximum.reduceat(high, at) if len(at) else at, edits[at]))):
        if best.get((r, i)) == 0:
            continue
        distance = edit_distance_within(items.words[items.first[i] : items.first[i + 1]], words[t.word_at[r] + s : t.word_at[r] + e], n)
        if distance <= n:
            best[r, i] = min(distance, best.get((r, i), distance))
    for (r, i), distance in best.items():
        yield t.first + r, i, distance, 1 - distance / int(items.first[i + 1] - items.first[i])


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, of at most about block words at once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    weight = rows.agg(F.sum(1 + F.length("text") / 4)).first()[0] or 0
    parts = max(1, math.ceil(weight / max(1, block)))
    for n in range(parts):
        yield sorted(((r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).collect()), key=lambda x: (x[0] is None, x))


def _prepared(benchmark: DataFrame, block: int, similarity: float) -> Iterator[Items]:
    for rows in _blocks(benchmark, block):
        yield prepare(rows, similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 500_000) -> DataFrame:
    """doc_id, item_id, distance (edits in words) and similarity for each benchmark item (item_id, text) found in a row of docs (doc_id, text)."""
    out = None
    for items in _prepared(benchmark, block, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                ids = batch.column("doc_id")
                for t in texts(pc.utf8_lower(batch.column("text")), space=BREAK):
                    found = sorted(meet(t, sent.value))
                    row, item, distance, similar = zip(*found) if found else ((), (), (), ())
                    named = [sent.value.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(named, pa.int64()), pa.array(distance, pa.int64()), pa.array(similar, pa.float64())], ["doc_id", "item_id", "distance", "similarity"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, distance long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 500_000) -> DataFrame:
    """docs without the rows that contain an item; all columns as they are."""
    for items in _prepared(benchmark, block, similarity):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                for t in texts(pc.utf8_lower(batch.column(batch.schema.get_field_index("text"))), space=BREAK):
                    for row, *_ in meet(t, sent.value):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
