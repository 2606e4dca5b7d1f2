"""XXH64 of many ranges of bytes at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
STRIPE = 32


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _read(data: np.ndarray, at: np.ndarray, kind: type) -> np.ndarray:
    """Little-endian numbers of that kind that stand at `at`."""
    width = np.dtype(kind).itemsize
    return data[at[:, None] + np.arange(width)].view(np.dtype(kind).newbyteorder("<"))[:, 0].astype(np.uint64)


def _round(held: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(held + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The XXH64 of data[start:end] (bytes) for each of the ranges."""
    size, at = (end - start).astype(np.int64), start.astype(np.int64)
    of = lambda n: np.full(n, np.uint64(seed))
    h = of(len(at)) + P5
    long = np.flatnonzero(size >= STRIPE)
    if len(long):
        lanes = [of(len(long)) + P1 + P2, of(len(long)) + P2, of(len(long)), of(len(long)) - P1]
        todo, place, left = np.arange(len(long)), at[long], size[long] // STRIPE
        while len(todo):
            for i in range(4):
                lanes[i][todo] = _round(lanes[i][todo], _read(data, place[todo] + 8 * i, np.uint64))
            place[todo] += STRIPE
            left[todo] -= 1
            todo = todo[left[todo] > 0]
        merged = sum(_left(x, n) for x, n in zip(lanes, (1, 7, 12, 18)))
        for x in lanes:
            merged = (merged ^ _round(np.uint64(0), x)) * P1 + P4
        h[long], at = merged, at.copy()
        at[long] = place
    h += size.astype(np.uint64)
    for width, kind in ((8, np.uint64), (4, np.uint32), (1, np.uint8)):
        todo = np.flatnonzero(end - at >= width)
        while len(todo):
            lane = _read(data, at[todo], kind)
            if width == 8:
                h[todo] = _left(h[todo] ^ _round(np.uint64(0), lane), 27) * P1 + P4
            elif width == 4:
                h[todo] = _left(h[todo] ^ lane * P1, 23) * P2 + P3
            else:
                h[todo] = _left(h[todo] ^ lane * P5, 11) * P1
            at[todo] += width
            todo = todo[end[todo] - at[todo] >= width]
    for shift, prime in ((33, P2), (29, P3)):
        h = (h ^ (h >> np.uint64(shift))) * prime
    return h ^ (h >> np.uint64(32))
