"""Operator 7: a quality classifier of supervised subword embeddings.

A document is the average of the learned vectors of its features, hashed into `buckets`: words, pairs of neighbouring words, character n-grams
inside words, starts and ends of words, and a mark for each word that equals the one before. A softmax layer on the average gives the classes'
probabilities. Vectors and layer are trained by numpy stochastic gradient descent on a bounded sample: at most `per_class` labelled texts of
each class, of different texts, chosen by hash; of a text the sample has at most `buckets` feature counts. Ids or texts whose labels contradict each other
teach nothing. Everything else covers all rows.

At scoring the layer is linear in the average, so each bucket's vector is reduced to its one logit before it is sent to the executors
(buckets * 4 bytes, whatever the input), and whole texts are scored slice by slice as arrays.

Defined results: a null or empty text has no features and gets the score of the layer's bias alone; without labels of both classes all scores
are 0.5; rows that repeat score alike; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, mix, texts, word_ranges

#: Lengths, in code points, of character n-grams, and of the starts and ends of words.
NGRAMS, AFFIX = (2, 3, 4), 3


def features(t: Texts, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every feature, a kind at a time."""

    def bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)

    words, row = t.hashes(), t.row_of_word()
    yield row, bucket(words, 1)
    begin = np.flatnonzero(np.arange(len(words)) + 2 <= t.ends())
    yield row[begin], bucket(word_ranges(words, begin, begin + 2), 2)
    same = begin[words[begin] == words[begin + 1]]
    yield row[same], bucket(np.zeros(len(same), np.uint64), 3)
    # where each character of a word begins and ends, and each word's first character and the one behind its last
    turn = np.zeros(len(t.data) + 1, np.int8)
    turn[t.start] += 1
    turn[t.end] -= 1
    char = (np.cumsum(turn, dtype=np.int8)[:-1] > 0) & ((t.data & 0xC0) != 0x80)
    rank = np.cumsum(char)
    first, last = rank[t.start] - 1, rank[t.end - 1]
    at, word = np.flatnonzero(char), np.repeat(np.arange(len(t.start)), last - first)
    after = np.append(at[1:], 0)
    if len(last):
        after[last - 1] = t.end
    yield row, bucket(t.byte_ranges(t.start, after[np.minimum(first + AFFIX, last) - 1]), 4)
    yield row, bucket(t.byte_ranges(at[np.maximum(last - AFFIX, first)], t.end), 5)
    for n in NGRAMS:
        i = np.flatnonzero(np.arange(len(at)) + n <= last[word])
        yield row[word[i]], bucket(t.byte_ranges(at[i], after[i + n - 1]), 10 + n)


@dataclass
class Model:
    """A logit for each bucket, and the bias; the score of class 1 is the logistic of bias + the mean over a text's features."""

    logits: np.ndarray
    bias: float = 0.0

    def scores(self, t: Texts) -> np.ndarray:
        total, count = np.zeros(t.rows), np.zeros(t.rows)
        for row, bucket in features(t, len(self.logits)):
            total += np.bincount(row, self.logits[bucket], t.rows)
            count += np.bincount(row, minlength=t.rows)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -500, 500)))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 1) -> Model:
    """samples: class (0 or 1), buckets and their shares of the text's features (sum 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)).tolist():
            label, ids, share = samples[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            layer -= now * np.outer(mean, error)
            bias -= now * error * 0.1
            # shares are small: a step is scaled up by the text's effective number of features
            vectors[ids] -= (now * min(64.0, 1 / float(share @ share))) * share[:, None] * back[None, :]
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, buckets: int = 1 << 16, **how: object) -> Model:
    """Train on docs (doc_id, text) labelled by labels (doc_id, quality); labels holds the rows to learn from and no others."""
    agree = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other").drop("_other")
    known = agree(labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")), "_id")
    each = lambda rows, key: [rows.filter(F.col("_label") == k).orderBy(F.xxhash64(key), key).limit(per_class) for k in (0, 1)]
    picked = each(known, "_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("_id")).filter("text is not null")
    # an id may have several texts, and a text several ids
    own = each(agree(labelled, "text"), "text")
    rows = own[0].unionByName(own[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_ = batch.column("_label").to_pylist()
            for t in texts(batch.column("text")):
                row, bucket = (np.concatenate(x) for x in zip(*features(t, buckets)))
                key, count = np.unique(row * buckets + bucket, return_counts=True)
                bounds = np.searchsorted(key, np.arange(t.rows + 1) * buckets)
                for r in range(t.rows):
                    a, b = bounds[r], bounds[r + 1]
                    yield pa.RecordBatch.from_pydict({"label": pa.array([labels_[t.first + r]], pa.int32()), "ids": [(key[a:b] % buckets).astype(np.int32).tobytes()], "counts": [count[a:b].astype(np.int32).tobytes()]})

    samples = []
    for r in sorted(rows.mapInArrow(run, "label int, ids binary, counts binary").collect()):  # 2 * per_class rows at most
        count = np.frombuffer(r.counts, np.int32).astype(np.float32)
        if len(count):
            samples.append((r.label, np.frombuffer(r.ids, np.int32), count / count.sum()))
    if len({s[0] for s in samples}) < 2:
        return Model(np.zeros(buckets, np.float32))
    return train(samples, buckets, **how)


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """columns of docs and score (of class 1) for each row, of its whole text."""
    chosen = docs.select(*columns, "text")
    kept = [f for f in chosen.schema.fields if f.name != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.scores(t) for t in texts(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(np.concatenate(found) if found else np.zeros(0))], [*(f.name for f in kept), "score"])

    return chosen.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))
