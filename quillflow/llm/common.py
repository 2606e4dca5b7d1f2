"""What the operators share: tables cut from their lineage, and words of whole texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.sources.shared import settled

#: A word is a run of bytes other than these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text that a task turns into arrays at once.
SLICE_BYTES = 1 << 18
#: Rows of a few numbers, some 16 MB, that may be broadcast.
BROADCAST_ROWS = 400_000

stage = settled


def lightly(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to have BROADCAST_ROWS rows at most; meant for tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """name, or what is made of it so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# Words as arrays -----------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _GRAM = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        have = _tables[base] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Texts:
    """Some consecutive texts of an Arrow array: bytes, and words as byte ranges with 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, space: np.ndarray = SPACE):
        self.first, self.rows, self._bytes = first, len(offsets) - 1, None
        self.data, self.at = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
        n = len(self.data)
        word = ~space[self.data]
        new = np.zeros(n + 1, bool)
        new[self.at] = True
        apart = new[1:n] if n else new[:0]
        start, end = word.copy(), word.copy()
        if n > 1:
            start[1:] &= ~word[:-1] | apart
            end[:-1] &= ~word[1:] | apart
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: Word i of row r stands at word_at[r] + i.
        self.word_at = np.searchsorted(self.start, self.at)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.word_at))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many of the texts' bytes are flagged, by row."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def byte_ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from start to end."""
        power, back = _powers(_BASE, len(self.data))
        if self._bytes is None:
            self._bytes = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=self._bytes[1:])
        return mix((self._bytes[end] - self._bytes[start]) * back[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.byte_ranges(self.start, self.end)

    def ends(self) -> np.ndarray:
        """For each word, where its text's words end."""
        return np.repeat(self.word_at[1:], np.diff(self.word_at))


def word_ranges(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sequences of word hashes from start to end."""
    power, back = _powers(_GRAM, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each word on, also across texts."""
    start = np.arange(max(0, len(words) - n + 1))
    return word_ranges(words, start, start + n)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of a part's texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, space: np.ndarray = SPACE) -> Iterator[Texts]:
    """The rows of a string column in slices of about limit bytes; a null is an empty text, a longer text a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Texts(data, offsets[row : last + 1], row, space)
        row = last
