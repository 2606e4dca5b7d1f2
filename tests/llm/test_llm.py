import collections
import gzip
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillflow.llm import classifier, common, components, decontamination, language_model, mixing, quality_rules, sharding, similar, simhash, substring, toxicity, urls, xxh
from quillflow.sources import shared
from tests.llm import brute

VOCAB = [a + b + c for a in "bdfkmprst" for b in "aeiou" for c in ("n", "l", "ro", "st", "é")]
ODD = [None, "", " \t\n", "one", "one\n", "ONE", "one two three four", "é" * 5000, "a b " * 9000, "|<># ***", "x" * 70_000]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, odd texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(50)]
    texts += [texts[3]] * 9 + [texts[7], texts[7].upper()]
    for base in (10, 11, 12):
        for _ in range(3):
            w = prose(rng, 120).split() if base == 12 else texts[base].split()
            if w:
                w[rng.randrange(len(w))] = "CHANGED"
            texts.append(" ".join(w))
    passage = prose(rng, 40)
    for k in range(8):
        texts.append(f"{prose(rng, 30)} {passage if k % 2 else passage[len(passage) // 3:]}\n{prose(rng, 20)}")
    texts += [passage + "\n" + passage, "line one here\nline one here\n\nline one here"] + ODD
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# Shared pieces ------------------------------------------------------------------------------------------------------------------------------


def test_word_arrays(rows):
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    seen = {}
    for limit in (50, 1 << 20):
        got = []
        for t in common.texts(column, limit):
            hashes = t.hashes()
            for r in range(t.rows):
                a, b = t.word_at[r], t.word_at[r + 1]
                got.append([t.data[s:e].tobytes().decode() for s, e in zip(t.start[a:b], t.end[a:b])])
                for w, h in zip(got[-1], hashes[a:b].tolist()):
                    assert seen.setdefault(w, h) == h
        assert got == [brute.words(t) for _, t in rows]
    assert len(set(seen.values())) == len(seen)
    assert list(common.texts(pa.array([], pa.string()))) == []


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    sets = brute.Sets({x for pair in links for x in pair})
    for a, b in links:
        sets.join(a, b)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {x: sets.root(x) for x in sets.up if sets.root(x) != x}
    assert components.roots(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# 1 Mixing -----------------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, docs, rows):
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(brute.words(t)) for i, t in rows}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = brute_targets(dict(sizes))
    got = mixing.taken(docs, block=16).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    words = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        words[r.source] += r.taken
    for s, n in words.items():
        assert math.floor(want[s]) == n
    again = mixing.taken(docs.repartition(5), block=16).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    assert mixing.taken(empty(spark)).count() == 0


def test_mixing_schedule_is_even(docs):
    measured, mixed = mixing.mix(docs, block=16)
    slots = [r.source_no for r in mixed.select("slot", "source_no").distinct().orderBy("slot").collect()]
    share = {s: slots.count(s) / len(slots) for s in set(slots)}
    for at in range(100, len(slots), 100):
        for s, p in share.items():
            assert abs(slots[:at].count(s) - p * at) <= 8
    assert measured.count() == docs.count()


CLASHING = "size key slot group item class sum runs n score known word _id _sum _toxic _label _taken _size _copy _own_id _gone_id quality item_id row start source_no".split()


def test_columns_of_other_names_are_left_alone(spark, docs, rows):
    more = docs.select("*", *[F.lit(n).alias(n) for n in CLASHING]).cache()
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int").select("*", *[F.lit(1).alias(c) for c in ("_id", "_label", "text")])
    bench = spark.createDataFrame([(1, "no such item anywhere to be found here at all")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    grammar = toxicity.fit(more, labels)
    for out in (mixing.repeat_mixed(more, block=16), simhash.one_of_each(more), similar.one_of_each(more), decontamination.without_leaks(more, bench), toxicity.without_toxic(more, grammar)):
        assert out.columns == more.columns and 0 < out.count() <= 2 * len(rows)
    model = classifier.fit(more, labels, buckets=256)
    for out in (mixing.taken(more, block=16), sharding.shard_by_bytes(more, 3), simhash.near_duplicates(more), similar.near_duplicates(more), language_model.score(more), substring.cut_repeats(more), quality_rules.judge(more, labels), classifier.score(more, model, "doc_id")):
        assert out.count() == len(rows)
    assert decontamination.leaks(more, bench).count() == 0


def test_repeat_mixed_keeps_columns(docs):
    out = mixing.repeat_mixed(docs.withColumn("size", F.lit("clash")), block=16)
    assert out.columns == [*docs.columns, "size"]
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_repeat_mixed_counts_rows_not_ids(spark):
    """Rows of no id in three sources, an id that two sources have, and an id of an empty and a full text: each row comes as often as its own text is taken."""
    rng = random.Random(3)
    rows = [(None, prose(rng, 60), s) for s in "abc" for _ in range(40)] + [(i, prose(rng, 60), s) for s in "abc" for i in range(20)] + [(7, None, "a"), (8, "", "b"), (9, " \n", None), (None, None, "c"), (5, prose(rng, 60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = collections.Counter()
    measured, mixed = mixing.mix(df, block=16)
    key = {(r.source_no, r.start): r.key for r in measured.filter("size > 0").collect()}
    for r in mixed.collect():
        taken[key[r.source_no, r.start]] += r.n_words
    hashed = df.select("*", F.xxhash64("doc_id", "text").alias("key")).collect()
    want = collections.Counter()
    for r in hashed:
        n = len((r.text or "").split())
        want[r.doc_id, r.text, r.source] += int(taken[r.key] / n + 0.5) if n else 1
    got = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.repeat_mixed(df, block=16).collect())
    assert got == +want and got[7, None, "a"] == 1 and got[None, None, "c"] == 1 and len({n for (i, _, s), n in got.items() if i is None}) > 1


# 2 Sharding ---------------------------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows):
    got = sharding.shard_by_bytes(docs, 5).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    where = collections.defaultdict(set)
    for r in got:
        b = (text[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(b))
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(empty(spark), 5).count() == 0
    even = spark.createDataFrame([(i, "x" * (50 + i % 30) + str(i)) for i in range(600)], "doc_id long, text string")
    sizes = [r.b for r in sharding.shard_by_bytes(even, 6).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 2


def test_differencing():
    assert sorted(np.bincount(sharding.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    assert sharding.differencing([], 3) == []
    pile = sharding.differencing([5] * 9, 3)
    assert sorted(pile.count(k) for k in range(3)) == [3, 3, 3]


# 3 Decontamination --------------------------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(n, prose(rng, rng.randint(13, 60))) for n in range(40)] + [(40, "tiny item"), (41, ""), (42, None), (None, "an item without any id"), (43, "no no no no no")]
    rows, planted = [], set()
    for n, item in items[:40]:
        w = item.split()
        for edits in (0, 1, 2):
            v = w.copy()
            for _ in range(min(edits, len(w) // 8)):
                v[rng.randrange(len(v))] = "zzz"
            if rng.random() < 0.3:
                v = [x.upper() for x in v]
            rows.append((len(rows), f"{prose(rng, rng.randint(0, 90))}. {', '.join(v)}! {prose(rng, rng.randint(0, 90))}"))
            planted.add((len(rows) - 1, n))
    clean = len(rows)
    rows += [(clean + k, prose(rng, 200)) for k in range(40)] + [(clean + 40 + k, t) for k, t in enumerate(ODD)] + [(900, "A Tiny, item."), (901, "so: an item without ID!"), (902, "No no, no no no no")] + [(903, rows[0][1])] * 2
    planted |= {(903, 0)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert len(planted & pairs) >= 0.98 * len(planted) and pairs - planted == {(900, 40), (901, None), (902, 43)}
    assert sum(r.doc_id == 903 for r in got) == 2
    norm = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    for r in got:
        assert r.distance == brute.edit_distance_within(norm(dict(items)[r.item_id]), norm(dict(rows)[r.doc_id]))
    left = {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in pairs}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, block=200).collect()} == pairs
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.without_leaks(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.leaks(docs.limit(0), bench).count() == 0


def edited(rng, item, k, kind):
    """item with k of its words edited."""
    w, n = item.copy(), len(item)
    if kind == "start":
        return ["zz"] * k + w[k:]
    if kind == "end":
        return w[: n - k] + ["zz"] * k
    for i, at in enumerate(rng.sample(range(n), k)):
        how = rng.choice(["replaced", "left out", "put in"]) if kind == "mixed" else kind
        if how == "evenly":
            w[(i + 1) * n // (k + 1)] = "zz"
        elif how == "replaced":
            w[min(at, len(w) - 1)] = "zz"
        elif how == "left out":
            del w[min(at, len(w) - 1)]
        else:
            w.insert(min(at, len(w) - 1), "zz")
    return w


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 11, 15, 20, 31, 40, 59, 120, 300])
def test_recall_at_the_limit(n):
    """Items of n words in documents with as many edits as the limit allows, of every kind: against the exact distance of all pairs, 0.95 are found."""
    rng = random.Random(n)
    items = [(i, prose(rng, n)) for i in range(40)]
    ready = decontamination.prepare(items, 0.8)
    k = n // 5
    for kind in ("start", "end", "evenly", "replaced", "left out", "put in", "mixed"):
        docs = [f"{prose(rng, rng.randint(0, 30))} {' '.join(edited(rng, item.split(), k, kind))} {prose(rng, rng.randint(0, 30))}".strip() for _, item in items]
        got = {(r, i): d for t in common.texts(pa.array(docs), space=decontamination.BREAK) for r, i, d, _ in decontamination.meet(t, ready)}
        number = {w: m for m, w in enumerate({w for t in docs + [t for _, t in items] for w in t.split()})}
        words = lambda text: np.array([number[w] for w in text.split()])
        pairs = [(r, i) for r in range(40) for i in range(40)] if n <= 20 else [(i, i) for i in range(40)]
        within = {(r, i): d for r, i in pairs if (d := decontamination.edit_distance_within(words(items[i][1]), words(docs[r]))) <= k}
        assert all((r, r) in within for r in range(40)) and got.items() <= within.items() and len(got) >= 0.95 * len(within), kind


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        item, region = ([rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontamination.edit_distance_within(np.array(item), np.array(region)) == brute.edit_distance_within(item, region)


# 4 Language model ---------------------------------------------------------------------------------------------------------------------------


def same_scores(got, want):
    got = {r.doc_id: (r.n_words, r.score, r.n_backed_off) for r in got.collect()}
    assert got.keys() == want.keys()
    for i, (n, s, b) in want.items():
        assert (got[i][0], got[i][2]) == (n, b) and (got[i][1] is None if s is None else math.isclose(got[i][1], s, abs_tol=1e-9)), i


@pytest.mark.parametrize(("order", "frequent"), [(1, 50), (2, 0), (2, 300), (2, 1 << 17), (3, 1 << 17)])
def test_backoff_scores(spark, docs, rows, order, frequent):
    """By the counts of all other documents, where at least a tenth of the words back off; and by those of a given corpus."""
    want = brute.backoff_scores(rows, order)
    same_scores(language_model.score(docs, order=order, frequent=frequent), want)
    assert order == 1 or 10 * sum(b for _, _, b in want.values()) >= sum(n for n, _, _ in want.values())
    corpus = [t for i, t in rows if i % 3 == 0]
    same_scores(language_model.score(docs, docs.filter("doc_id % 3 = 0"), order=order), brute.backoff_scores(rows, order, corpus))
    assert language_model.score(empty(spark), order=order).count() == 0
    assert all(r.score is None for r in language_model.score(docs, empty(spark), order=order).collect())


@pytest.mark.parametrize(("bits", "frequent"), [(8, 0), (8, 40), (14, 300)])
def test_backoff_scores_with_a_full_bitmap(spark, docs, rows, monkeypatch, bits, frequent):
    """A bitmap in which nearly every bit is set, or many are, sends more rows to the joins and changes no score."""
    monkeypatch.setattr(language_model, "BITMAP", bits)
    monkeypatch.setattr(language_model, "PART", 3)
    same_scores(language_model.score(docs, frequent=frequent), brute.backoff_scores(rows, 2))


def test_backoff_scores_in_small_blocks(spark, docs, rows, monkeypatch):
    """Blocks of a few rows, ids of any size or none among them, and documents that come in parts change no score."""
    for name, size in (("PACK", 50), ("ADD", 20)):
        monkeypatch.setattr(language_model, name, size)
    far = [(i if i is None else i * (-(2**55) if i % 2 else 2**40), t) for i, t in rows]
    got = language_model.score(spark.createDataFrame(far, "doc_id long, text string"), frequent=40)
    want = brute.backoff_scores(rows, 2)
    same_scores(got, {i if i is None else i * (-(2**55) if i % 2 else 2**40): x for i, x in want.items()})


def test_a_language_model_shuffles_few_bytes_and_leaves_no_counts(spark, tmp_path):
    """Rows take under 18 bytes in the join of 20 000 words (those of 80 bytes took over 21), and the counts' shuffle is gone when they are settled."""
    words = np.arange(20_000, dtype=np.uint64) * np.uint64(2**40 + 12345)
    key, n = common.mix(words), np.ones(len(words), np.int64)
    blocks = language_model._blocks(language_model.KEPT, key, n, np.sort(words.view(np.int64) % 50), n.astype(np.uint8) * 0, (key >> np.uint64(25)).view(np.int64))
    held = language_model._Rows(blocks, language_model.KEPT)
    assert sorted(held.key) == sorted(key) and (held.n == 1).all() and not held.no_doc.any() and held.fixed.max() < 2**40
    with gzip.open(tmp_path / "x", "wb", compresslevel=1) as f:
        f.writelines(b or b"" for name in blocks.schema.names[2:] for b in blocks.column(name).to_pylist())
    assert os.path.getsize(tmp_path / "x") < 18 * len(words)
    before = set(shuffles(spark))
    with shared.leanly(spark):
        common.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "test")
    assert set(shuffles(spark)) <= before


def shuffles(spark):
    return [f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _, _, files in os.walk(str(d)) for f in files if f.startswith("shuffle_") and f.endswith(".data")]


def test_backoff_of_what_one_text_repeats(spark):
    """Pairs that one text alone repeats back off; a lone text knows nothing; equal texts know each other's pairs; a start is no word."""
    rows = [(1, "a b a b a b"), (2, "b a"), (3, "new words here"), (4, "new words here"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (1, 2, 3):
        same_scores(language_model.score(df, order=order), brute.backoff_scores(rows, order))
    lone = language_model.score(df.filter("doc_id = 1")).first()
    assert lone.n_backed_off == 6 and math.isclose(lone.score, math.log10(0.4))


def test_backoff_scores_of_repeated_ids(spark, docs, rows):
    """Rows of one id, and of none, are taken together, each text without itself in the counts."""
    ids = {i: i // 2 if i % 5 else None for i, _ in rows}
    df = spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string")
    for order in (2, 3):
        own, want = {r.doc_id: r for r in language_model.score(df, order=order).collect()}, collections.defaultdict(list)
        for i, found in brute.backoff_scores(rows, order).items():
            want[ids[i]].append(found)
        assert own.keys() == want.keys()
        for i, parts in want.items():
            n = sum(x for x, _, _ in parts)
            assert (own[i].n_words, own[i].n_backed_off) == (n, sum(b for _, _, b in parts))
            assert (own[i].score is None) if not n else math.isclose(own[i].score, sum(x * s for x, s, _ in parts if x) / n, abs_tol=1e-9)


# 5 URLs -------------------------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://a.example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "HTTP://WWW.EXAMPLE.COM/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://com/EN": ("com", "/EN", "com/", "allow"), "x://b.net/es/": ("b.net", "/es/", "net/es/", "block"), "http://notcom/": ("notcom", "/", None, "allow"),
        "http://com?x/": ("com", "", None, "allow"), "no url": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(n, u, "extra") for n, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df.drop("rule"), rules).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df.union(df).drop("rule"), rules).count() == 2 * len(cases)
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0), "block").collect()} == {"block"}


# 6 Near duplicates --------------------------------------------------------------------------------------------------------------------------


def test_simhash(spark, docs, rows):
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash_components(rows)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {c for _, c in got.values()}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [2048, 30, 6])
def test_links_in_large_groups(spark, group):
    rng = random.Random(3)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(20)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {simhash._signed(x): x for x in prints}
    sets = brute.Sets(signed)
    for a in signed:
        for b in signed:
            if a < b and (signed[a] ^ signed[b]).bit_count() <= 3:
                sets.join(a, b)
    mine = brute.Sets(signed)
    for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, group).collect():
        mine.join(r.a, r.b)
    assert {x: mine.root(x) for x in signed} == {x: sets.root(x) for x in signed}


def test_similar(spark, docs, rows):
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == brute.similar_components(rows)
    assert {r.doc_id for r in similar.one_of_each(docs.withColumn("class", F.lit(1))).collect()} == set(got.values())
    assert similar.near_duplicates(empty(spark)).count() == 0 and similar.one_of_each(empty(spark)).count() == 0


def test_one_of_each_row(spark):
    """One row of each component stays, whatever the ids: other texts under one id, ids that are null, rows that repeat."""
    a, b, c = ("red green blue " * 5, "one two three four five six seven", "this text has no equal at all")
    rows = [(3, a), (7, a), (7, b), (7, b), (None, a.upper()), (None, c), (None, c), (9, b), (None, None), (4, "")]
    for part in (similar, simhash):
        kept = part.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("Class", F.lit("x")))
        assert kept.columns == ["doc_id", "text", "Class"]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (7, b), (None, c), (4, "")], key=str)


def test_null_ids_hold_a_chain(spark):
    """The text between two others, near to both, has no id."""
    rng = random.Random(3)
    w = prose(rng, 60).split()
    chain = [" ".join(w), " ".join(w[:-5] + ["x"] * 5), " ".join(["y"] * 5 + w[5:-5] + ["x"] * 5)]
    rows = [(1, chain[0]), (None, chain[1]), (5, chain[2])]
    want = brute.similar_components([(1, chain[0]), (2, chain[1]), (5, chain[2])])
    assert brute.similar_components([rows[0], rows[2]]) == {1: 1, 5: 5} and want[5] == 1
    assert {r.component_id for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def components_of(df, group):
    """Components with a group size of the test's own."""
    return {r.doc_id: r.component_id for r in similar.judged(df, 5, 0.8, group)[0].collect()}


@pytest.mark.parametrize("group", [1024, 20])
def test_similar_dense_groups(spark, group):
    """Near copies of one text with up to five words changed, at and about the limit: components are those of all pairs."""
    rng = random.Random(8)
    base = prose(rng, 200).split()
    rows = []
    for i in range(300):
        w = base.copy()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 100)) for i in range(60)]
    assert components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group) == brute.similar_components(rows)


@pytest.mark.parametrize("group", [4096, 50])
def test_similar_pairs_among_a_template(spark, group):
    """Pairs at 0.82 among texts that share a passage, at about 0.7 to each other."""
    rng = random.Random(31)
    base = prose(rng, 330).split()
    texts = [base + prose(rng, 70).split() for _ in range(1200)]
    for k in range(40):
        w = texts[k].copy()
        w[-37:] = prose(rng, 37).split()
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group)
    assert got == {i: i - 1200 if i >= 1200 else i for i, _ in rows}


def test_xxh64_of_ranges():
    """All lengths about the stripes' and lanes' ends equal the reference implementation of the hash."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    start = rng.integers(0, 4000, 400)
    end = start + np.concatenate([np.arange(140), rng.integers(0, 5000, 260)])
    assert xxh.xxh64(data, start, end, 42).tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(start, end)]


def family_of(spark, sets):
    """One family, in 12 parts, of classes with these sets."""
    rows = [(0, i, len(x), i * 7919 % 12, sorted(x)) for i, x in enumerate(sets)]
    frame = pd.DataFrame(rows, columns=["family", "class", "size", "part", "shingles"])
    return spark.createDataFrame(frame, "family long, class long, size long, part int, shingles array<long>").repartition(8)


@pytest.mark.parametrize("own", [30, 11])
def test_similar_rows_of_a_template_grow_in_proportion(spark, own):
    """Texts with 60 shingles in common and 30 or 11 of their own, at 0.5 and 0.73: what they send grows with their number, and only planted pairs are compared."""
    sent = []
    for n in (3000, 12000):
        sets = [{*range(60), *range(1000 + i * own, 1000 + (i + 1) * own)} for i in range(n)]
        for k in range(7):  # a copy with two of its own changed: (60 + own - 2) of (60 + own + 2)
            sets.append({*sorted(sets[k])[:-2], -2 * k - 1, -2 * k - 2})
        large = family_of(spark, sets)
        met = similar.prefixes(large, 0.8).cache()
        cells = similar._met_cells(met.withColumn("root", F.col("class")), 0.8)
        assert {r["class"] for r in cells.select("class").collect()} == {*range(7), *range(n, n + 7)}
        sent.append(met.count())
        assert {(min(r), max(r)) for r in similar._large_links(large, 0.8, 1024).collect()} == {(k, n + k) for k in range(7)}
        met.unpersist()
    assert sent[1] <= 4.2 * sent[0] + 100


@pytest.mark.parametrize("paired", [4096, 3])
def test_similar_large_families_equal_brute_force(spark, monkeypatch, paired):
    """Clusters about the limit with common and rare shingles, sets of very different sizes: components are those of all pairs."""
    monkeypatch.setattr(similar, "PAIRED", paired)
    rng = random.Random(17)
    sets = []
    for _ in range(12):
        base = rng.sample(range(4000), rng.randint(8, 120))
        for _ in range(rng.choice([1, 5, 40])):
            kept = rng.sample(base, len(base) - rng.randint(0, len(base) // 6))
            sets.append({*kept, *rng.sample(range(4000), rng.randint(0, len(base) // 8)), *range(5000, 5000 + rng.choice([0, 3, 30]))})
    want, got = brute.Sets(range(len(sets))), brute.Sets(range(len(sets)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        want.join(i, j)
    for i, j in similar._large_links(family_of(spark, sets), 0.8, 16).collect():
        assert (min(i, j), max(i, j)) in pairs
        got.join(i, j)
    assert len(pairs) > 100 and {i: got.root(i) for i in range(len(sets))} == {i: want.root(i) for i in range(len(sets))}


def test_similar_recall_at_the_limit(spark):
    """Lone pairs at just 0.8: blocks find them with 0.98."""
    rng = random.Random(12)
    rows = []
    for k in range(300):
        w = prose(rng, 94).split()  # 90 shingles; the ten last words changed leave 80 of 100
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-10] + prose(rng, 10).split()))]
    got = components_of(spark.createDataFrame(rows, "doc_id long, text string"), 1024)
    assert all(got[i] in (i, i - i % 2) for i, _ in rows) and sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 0.95 * 300


@pytest.mark.parametrize("batch", [7, 40, 1000])
def test_similar_groups_at_any_cut(batch):
    """Whatever the batches: links join all that is close in a key."""
    rng = np.random.default_rng(5)
    sizes = [3, 90, 11, 1, 30, 9]
    key = np.repeat(np.arange(len(sizes)), sizes)
    fp = rng.integers(0, 2**63, (1, 2), np.uint64) ^ (rng.integers(0, 2**63, (len(key), 2), np.uint64) & rng.integers(0, 2**63, (len(key), 2), np.uint64) & rng.integers(0, 2**63, (len(key), 2), np.uint64))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key))), *(pa.array(x.view(np.int64)) for x in fp.T.copy())], ["key", "class", "fp0", "fp1"])
    for group in (8, 1000):
        out = [r for b in similar._close(34, group)(rows.slice(at, batch) for at in range(0, len(key), batch)) for r in b.to_pylist()]
        sets, want = brute.Sets(range(len(key))), brute.Sets(range(len(key)))
        for r in out:
            assert key[r["a"]] == key[r["b"]]
            sets.join(r["a"], r["b"])
        close = [(i, j) for j in range(len(key)) for i in range(j) if key[i] == key[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 34]
        for i, j in close:
            want.join(i, j)
        assert len(close) > 500 and len(out) <= len(key) and all(sets.root(i) == sets.root(j) for i, j in close)
        assert group == 8 or [sets.root(i) for i in range(len(key))] == [want.root(i) for i in range(len(key))]


def test_blocks_keep_their_recall():
    assert similar.near(0.8) == 34 and similar.near(0.7) > 34 > similar.near(0.9)
    for classes in (0, 10, 10**6, 10**10):
        chosen = similar.blocks(classes, 0.8)
        bits = len(chosen[0])
        assert 1 - (1 - (1 - math.acos(1.6 / 1.8) / math.pi) ** bits) ** len(chosen) >= 0.98 and classes / 2**bits <= similar.BY_CHANCE
        assert len(chosen) << bits < 2**63


# 7 Classifier -------------------------------------------------------------------------------------------------------------------------------


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: prose(rng, rng.randint(20, 80))
    bad = lambda: rng.choice([lambda: " ".join(w + "***" for w in good().split()), lambda: " ".join(w for w in good().split() for _ in range(7)), lambda: good().upper() + "!!"])()
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 200] + [(None, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    model = classifier.fit(df, labels, buckets=1 << 14)
    got = {r.doc_id: r.score for r in classifier.score(df, model, "doc_id").collect()}
    held = [(got[i] >= 0.7) == bool(q) for i, _, q in rows if i >= 200]
    assert len(got) == 300 + len(ODD) and sum(held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())
    again = classifier.fit(df.repartition(7), labels, buckets=1 << 14)
    assert np.array_equal(model.logits, again.logits)
    flat = classifier.fit(df, labels.limit(0), buckets=64)
    assert {r.score for r in classifier.score(df, flat, "doc_id").collect()} == {0.5}
    assert classifier.score(df.limit(0), model, "doc_id").count() == 0


# 8 Substrings -------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "seed"), [(13, 5), (5, 2), (3, 3)])
def test_substrings(spark, docs, rows, length, seed):
    out = substring.cut_repeats(docs, length, seed).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out} == brute.cut(rows, length)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(s.end - s.start >= length for s in r.spans)
    assert substring.cut_repeats(empty(spark), length, seed).count() == 0


def test_substrings_of_rows_that_repeat(spark):
    rng = random.Random(1)
    a, b = prose(rng, 30), prose(rng, 30)
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, a), (2, a + " " + b), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.cut_repeats(df).collect()) == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 60, 60), (3, 30, 30)]


def test_substring_batches(spark, docs, rows):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        out = substring.cut_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
        near = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
        fine = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    finally:
        spark.conf.set(key, before)
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out} == brute.cut(rows)
    assert near == brute.similar_components(rows)
    assert fine == {i: c for i, (_, c) in brute.simhash_components(rows).items()}


# 9 Quality rules ----------------------------------------------------------------------------------------------------------------------------


def test_measures(docs, rows):
    got = {r.doc_id: r for r in quality_rules.measure(docs, "doc_id").withColumn("bad", quality_rules.base_failed()).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.bad) == brute.quality(t), t


def test_bounds():
    assert math.isclose(quality_rules.at_most(0, 100, 0.03), 0.97**100)
    assert quality_rules.at_most(5, 5, 0.5) == 1.0
    p = quality_rules.upper_bound(2, 50, 0.05)
    assert math.isclose(quality_rules.at_most(2, 50, p), 0.05, rel_tol=1e-6) and quality_rules.upper_bound(0, 0, 0.05) == 1.0


def test_rules_hold_their_limit(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 4 == 0
        w = prose(rng, 25).split()
        if bad or rng.random() < 0.002:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(not bad)))
    rows += [(9000, "few words", None), (9001, None, "en"), (9002, " ".join(x + "#" for x in prose(rng, 20).split()), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"), limit=0.04).collect()}
    assert len(got) == len(rows)
    assert not any(got[i].kept for i in range(0, 3000, 4))
    lost = sum(not got[i].kept for i in range(3000) if i % 4)
    assert lost <= 0.02 * 2250
    assert not got[9000].kept and not got[9001].kept and got[9002].kept  # a stratum without labels rejects nothing by rule
    assert got[0].failed == ["symbols"]
    none = quality_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.filter("size(failed) > 0").count() == 0
    assert quality_rules.judge(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


# 10 Toxicity --------------------------------------------------------------------------------------------------------------------------------


def test_grammar():
    g = toxicity.Grammar({"idiot": 2.0}, {"scum": 3.0}, 0.0, 1.0)
    find = g.finder()
    total = lambda t: g.total(t, find)
    assert total(None) == total("") == total("a plain sentence.") == 0
    assert total("he is an idiot.") == 2 and total("You idiot!") == 3 and total("idiots") == 0 and total("scummy") == 3
    assert total("not an idiot") < total("an idiot") and total("she said he is an idiot") < total("he is an idiot")
    assert total("I will kill you") == 3 and total("I will kill time. You wait") == 0
    assert total("idiot\nidiot") == 4


def test_toxicity(spark):
    rng = random.Random(13)
    bad = ["blarg", "snivelling", "gronk", "dreckig"]
    rows = []
    for i in range(400):
        w = prose(rng, 60).split()
        if i % 3 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000 + k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, score string")
    grammar = toxicity.fit(df.drop("score"), spark.createDataFrame([(i, x) for i, _, x in rows if i < 250] + [(None, 1), (9999, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(df.drop("score"), grammar, "doc_id").collect()}
    right = [(got[i] >= 0.5) == bool(x) for i, _, x in rows if i >= 250]
    assert sum(right) >= 0.97 * len(right) and all(0 <= s <= 1 for s in got.values()) and all(got[1000 + k] < 0.5 for k in range(len(ODD)))
    left = toxicity.without_toxic(df, grammar)
    assert left.columns == df.columns and left.count() == sum(s < 0.5 for s in got.values())
    assert toxicity.fit(df.drop("score"), spark.createDataFrame([], "doc_id long, toxic int")).words == {}
    assert toxicity.score(df.limit(0).drop("score"), grammar, "doc_id").count() == 0
