"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


class Sets:
    """Union-find over ids; the root is the least id."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def simhash(text, n=3):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if counts[bit] * 2 > len(grams))


def simhash_components(rows, bits=3):
    """rows: (doc_id, text)."""
    prints = [(i, simhash(t)) for i, t in rows]
    sets = Sets(i for i, _ in rows)
    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if (x ^ y).bit_count() <= bits:
                sets.join(a, b)
    return {i: (f"{x:016x}", sets.root(i)) for i, x in prints}


def similar_components(rows, n=5, similarity=0.8):
    sets, shingled = Sets(i for i, _ in rows), []
    for i, t in rows:
        w = tuple(words((t or "").translate(LOWER)))
        grams = {w[k : k + n] for k in range(max(1, len(w) - n + 1))} if w else set()
        for j, (v, other) in shingled:
            if v == w or grams and other and len(grams & other) >= similarity * len(grams | other):
                sets.join(i, j)
        shingled.append((i, (w, grams)))
    return {i: sets.root(i) for i, _ in rows}


def cut(rows, length=13):
    """rows: (doc_id, text), ids different: (n_words, n_removed, sha of what is kept)."""
    first, split = {}, {i: words(t) for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - length + 1):
            first.setdefault(tuple(split[i][k : k + length]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    text, w = text or "", words(text)
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = [False] * len(w)
    for k in range(len(w) - 4):
        if seen[tuple(w[k : k + 5])] > 1:
            again[k : k + 5] = [True] * 5
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n, r = len(w), sum(again)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n)


def edit_distance_within(item, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(region, 1):
            now.append(min(row[j - 1] + (c != d), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def backoff_scores(rows, order, corpus=None, backoff=0.4):
    """rows: (doc_id, text), ids different; corpus: texts, of the other rows by default: doc_id to (n_words, mean log10 score, words that back off)."""
    split = {i: words((t or "").lower()) for i, t in rows}

    def counted(known):
        count = collections.Counter()
        for o in range(1, order + 1):
            for x in known:
                padded = ["<s>"] * (o - 1) + x if x else []
                count.update(("gram", *padded[k : k + o]) for k in range(len(padded) - o + 1))
                count.update(("context", *padded[k : k + o - 1]) for k in range(len(padded) - o + 2))
        return count, sum(map(len, known))

    everything, total = counted(list(split.values()) if corpus is None else [words((t or "").lower()) for t in corpus])
    out = {}
    for i, x in split.items():
        own, size = counted([x]) if corpus is None else (collections.Counter(), 0)
        count = lambda *key: everything[key] - own[key]
        scores = []
        for k in range(len(x)):
            padded = ["<s>"] * (order - 1) + x[: k + 1]
            grams = {o: padded[len(padded) - o :] for o in range(1, order + 1)}
            o = next((o for o in range(order, 1, -1) if count("gram", *grams[o])), 1)
            share = count("gram", *grams[o]) / count("context", *grams[o][:-1]) if o > 1 else max(1, count("gram", *grams[1])) / max(1, total - size)
            scores.append((math.log10(share) + (order - o) * math.log10(backoff), o < order))
        out[i] = (len(x), sum(v for v, _ in scores) / len(x) if x and total else None, sum(b for _, b in scores))
    return out
