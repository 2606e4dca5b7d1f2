"""The learned operators and the mix against slow versions of their inner loops, and on rows that repeat ids or contradict each other."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillflow.llm import classifier, common, decontamination, mixing, quality_rules, sharding, toxicity, urls
from tests.llm import brute
from tests.llm.test_llm import ODD, VOCAB, prose

# Toxicity -----------------------------------------------------------------------------------------------------------------------------------

TOKENS = ["idiot", "scummy", "kill", "you", "not", "said", "house", "tree"]
GRAMMAR = toxicity.Grammar({"idiot": 2.0}, {"scum": 3.0}, 0.01, 1.0)


def slow_clause(tokens):
    """The five parts side by side, without transducers."""
    total, said, since_threat, aimed, since_no, reported = 0.0, set(), None, False, None, False
    for token in tokens:
        insult = 2.0 if token == "idiot" else 3.0 if token.startswith("scum") and len(token) > 4 else 0.0
        target, threat = token in toxicity.TARGETS.split(), token in toxicity.THREATS.split()
        worth, by = (1.0 if insult else 0.0), 1.0
        if target and since_threat is not None and since_threat < 4:
            worth += 3.0
        if insult and aimed:
            by *= 1.5
        if (insult or target) and since_no is not None and since_no < 3:
            by *= 0.5
        if (insult or target) and reported:
            by *= 0.5
        since_threat = 0 if threat else None if since_threat is None or target else since_threat + 1
        since_no = 0 if token in toxicity.NEGATIONS.split() else None if since_no is None else since_no + 1
        aimed, reported = aimed or target, reported or token in toxicity.REPORTS.split()
        if token in said:
            continue
        if insult:
            said.add(token)
        total += worth * by * (insult or 1.0)
    return total


def test_clauses_against_a_slow_machine():
    rng = random.Random(4)
    finder = GRAMMAR.finder()
    for _ in range(400):
        clauses = [[rng.choice(TOKENS) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        for c in clauses:
            assert math.isclose(GRAMMAR.clause(" ".join(c)), slow_clause(c), abs_tol=1e-9), c
        text = rng.choice([". ", "! ", "\n"]).join(" ".join(c) for c in clauses)
        words = 1 + text.count(" ") + text.count("\n") if text else 0
        assert math.isclose(GRAMMAR.total(text.upper(), finder), sum(map(slow_clause, clauses)) - 0.01 * words, abs_tol=1e-9), text


def test_cut():
    assert toxicity.best_cut([(5.0, 1), (4.0, 1), (1.0, 0), (0.0, 0)]) == 2.5
    assert toxicity.best_cut([(5.0, 1), (2.0, 0), (1.0, 1), (0.0, 0), (0.0, 0)]) == 0.5
    assert toxicity.best_cut([(0.2, 1), (0.1, 0)]) == 0.5 and toxicity.best_cut([]) == 1.0


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        w = prose(rng, rng.randint(30, 60)).split()
        if i % 3 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "gronkish", "snivel"]))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows


def test_learning_is_stable(spark):
    """Neither the order of rows, nor held-out rows, nor labels that contradict each other change what is learned; ids may repeat."""
    rows = toxic_rows(random.Random(8), 240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i < 180], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    assert "blarg" in grammar.words
    more = docs.unionByName(spark.createDataFrame([(5000, "blarg house"), (5000, "tree"), (170, rows[170][1] + " zzz"), (None, "blarg")], "doc_id long, text string"))
    odd = labels.unionByName(spark.createDataFrame([(5000, 0), (5000, 1), (5001, 1), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.fit(more.repartition(5), odd.repartition(3)) == grammar
    got = collections.Counter((r.doc_id, r.score >= 0.5) for r in toxicity.score(more, grammar, "doc_id").collect())
    assert sum(got.values()) == 244 and all(got[i, bool(k)] for i, _, k in rows if i >= 180)


# Quality classifier -------------------------------------------------------------------------------------------------------------------------


def slow_features(text):
    """(kind, what) of every feature, by characters."""
    w = brute.words(text)
    out = [(1, x) for x in w] + [(2, p) for p in zip(w, w[1:])] + [(3, "") for a, b in zip(w, w[1:]) if a == b]
    out += [(4, x[:3]) for x in w] + [(5, x[-3:]) for x in w]
    return out + [(10 + n, x[k : k + n]) for n in classifier.NGRAMS for x in w for k in range(len(x) - n + 1)]


def test_features_against_a_slow_loop():
    rng = random.Random(3)
    column = [prose(rng, 30), "é ééé naïve 漢字かな交じり文 x", *(t for t in ODD if not t or len(t) < 3000), "a a a b"]
    buckets = 1 << 40
    named = {}
    for t in common.texts(pa.array(column)):
        found = list(classifier.features(t, buckets))
        for r in range(t.rows):
            got = sorted(b for row, bucket in found for b in bucket[row == r].tolist())
            slow = slow_features(column[t.first + r])
            assert len(got) == len(slow)
            by_name = collections.Counter(slow)
            by_bucket = collections.Counter(got)
            assert sorted(by_name.values()) == sorted(by_bucket.values())
            # one text alone gives each of its features its bucket
            if len(by_name) == 1:
                named[next(iter(by_name))] = got[0]
    logits = np.random.default_rng(1).normal(size=64).astype(np.float32)
    model = classifier.Model(logits, 0.25)
    for t in common.texts(pa.array(column)):
        rows = [[b for row, bucket in classifier.features(t, 64) for b in bucket[row == r].tolist()] for r in range(t.rows)]
        want = [1 / (1 + math.exp(-(0.25 + (sum(float(logits[b]) for b in x) / len(x) if x else 0.0)))) for x in rows]
        assert np.allclose(model.scores(t), want, atol=1e-6)


def test_equal_characters_have_equal_features():
    """The same ending in words of other bytes: features are of characters, not of halves of them."""
    by_kind = lambda text: [set(b.tolist()) for t in common.texts(pa.array([text])) for _, b in classifier.features(t, 1 << 40)]
    one, other = by_kind("xéü"), by_kind("漢éü")
    assert len(one[5] & other[5]) == 1 and not one[3] & other[3]  # the last two characters; the start is another
    assert len(by_kind("éü")[5]) == 1 and not by_kind("é")[5]


def test_contradicting_labels_teach_nothing(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) if i % 2 else " ".join(w + "***" for w in prose(rng, 40).split()), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = classifier.fit(docs, labels, buckets=1 << 12)
    # a text under two ids with both labels, an id with both, an id with two texts of which one contradicts another row
    more = docs.unionByName(spark.createDataFrame([(900, "same text"), (901, "same text"), (902, "other text")], "doc_id long, text string"))
    odd = labels.unionByName(spark.createDataFrame([(900, 0), (901, 1), (902, 0), (902, 1)], "doc_id long, quality int"))
    for parts in (1, 6):
        again = classifier.fit(more.repartition(parts), odd.repartition(parts), buckets=1 << 12)
        assert np.array_equal(model.logits, again.logits) and model.bias == again.bias


# The mix ------------------------------------------------------------------------------------------------------------------------------------


def test_a_schedule_of_many_slots(spark):
    """Beyond 2**31 slots: shares cover [0, 1) in order and points fall into them; the whole schedule is not made."""
    need = [3_000_000_000, 1, 2_500_000_000, 40_000_000_000]
    slots = sum(need)
    sources = spark.createDataFrame(list(enumerate(need)), "source_no long, need long")
    shares = mixing._shares(sources, slots)
    spans = {r.source_no: (r.low, r.high) for r in shares.collect()}
    assert min(a for a, _ in spans.values()) == 0 and max(b for _, b in spans.values()) == mixing.POINTS
    start = (1 << 35) + 12345
    drawn = collections.Counter(r.source_no for r in mixing._drawn(shares, spark.range(start, start + 20_000).select(F.col("id").alias("slot"))).collect())
    assert sum(drawn.values()) == 20_000
    for no, n in enumerate(need):
        assert abs(drawn[no] - 20_000 * n / slots) <= 4


def test_mix_of_repeated_and_missing_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), prose(rng, rng.randint(0, 30)), rng.choice(["a", "b", None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df, block=8).collect()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in got) == collections.Counter((i, s, len(brute.words(t))) for i, t, s in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b", None):
        assert sum(r.taken for r in got if r.source == s) == math.floor(next(r.target for r in got if r.source == s))
    copies = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.repeat_mixed(df.withColumn("_COPY", F.lit(1)), block=8).collect())
    for i in (1, 2, None):
        size, took = (sum(getattr(r, c) for r in got if r.doc_id == i) for c in ("size", "taken"))
        for t, n in collections.Counter(x for x in rows if x[0] == i).items():
            times = math.floor(took / size + 0.5) if size else 1
            assert copies[t] == n * times


# Repeated ids elsewhere ---------------------------------------------------------------------------------------------------------------------


def test_shards_of_repeated_ids_are_even(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, "", *(prose(rng, n) for n in range(1, 9))]) if rng.random() < 0.4 else prose(rng, rng.randint(1, 60))) for _ in range(900)]
    placed = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len(placed) == len(rows)
    size = collections.Counter()
    for r in placed:
        assert r.size == len((r.text or "").encode()) + 8 if "text" in r.asDict() else True
        size[r.shard] += r.size
    assert len(size) == 5 and max(size.values()) - min(size.values()) <= 64
    for shard in range(5):
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(sum(r.shard == shard for r in placed)))


def test_rows_that_repeat_are_judged_each(spark):
    rng = random.Random(2)
    text = prose(rng, 60)
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (1, "few", None), (None, None, "en")], "doc_id long, text string, lang string")
    judged = quality_rules.judge(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted((r.n_words, r.kept) for r in judged.collect()) == [(0, False), (1, False), (60, True), (60, True)]
    bench = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    assert collections.Counter((r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()) == {(1, 7): 4}


@pytest.mark.parametrize("n", [1, 400])
def test_hosts_of_many_labels(spark, n):
    host = "a." * n + "example.com"
    rules = spark.createDataFrame([("example.com", "/x", "block"), ("com", "/", "allow"), ("a.example.com", "/x", "allow"), ("", "", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://{host}/x/y"), (2, "http://example.com/x"), (3, None), (4, "http://com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, "block").collect()}
    assert got == {1: ("a.example.com/x", "allow"), 2: ("example.com/x", "block"), 3: ("", "allow"), 4: (None, "block")}


def test_texts_of_the_vocabulary_only():
    assert all(re.fullmatch(r"\w+", w) for w in VOCAB)


# Quality rules --------------------------------------------------------------------------------------------------------------------------------


def slow_kept(rows, labels, limit, level):
    """rows: (doc_id, text, lang): kept of each by a plain recount and an exact test with whole numbers."""
    names = ("symbols", "repeats", "dup_lines", "capitals")

    def measures(text):
        n, chars, symbols, dup, again, bad = brute.quality(text)
        lines = sum(bool(brute.words(x)) for x in (text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        return bad, (symbols / max(1, chars), again / max(1, n), dup / max(1, lines), capitals / max(1, chars))

    found = [(i, t, lang, *measures(t)) for i, t, lang in rows]
    strata = collections.defaultdict(dict)
    for i, t, lang, _, m in found:
        if i in labels:
            q = max(labels[i], strata[lang][t][0]) if t in strata[lang] else labels[i]
            strata[lang][t] = (q, m)
    tests = max(1, len(strata)) * len(names)
    cut = {}
    for lang, texts in strata.items():
        good = [m for q, m in texts.values() if q == 1]
        bad = [m for q, m in texts.values() if q != 1]
        for k, name in enumerate(names):
            best, share = 0, limit / len(names)
            for value in quality_rules.LADDER:
                lost, caught = sum(m[k] > value for m in good), sum(m[k] > value for m in bad)
                chance = sum(math.comb(len(good), j) * share**j * (1 - share) ** (len(good) - j) for j in range(lost + 1)) if lost < len(good) else 1.0
                if lost > len(good) * share or chance > level / tests:
                    break
                if caught - lost > best:
                    best, cut[lang, k] = caught - lost, value
    return [(i, not bad and not any(m[k] > cut.get((lang, k), math.inf) for k in range(len(names)))) for i, t, lang, bad, m in found]


def test_kept_against_a_plain_recount(spark):
    rng = random.Random(21)
    rows, labels = [], {}
    for i in range(1600):
        lang = rng.choice(["en", "en", "en", "de", None])
        kind = rng.choice(["good"] * 5 + ["symbols", "capitals", "lines", "repeats"])
        w = prose(rng, rng.randint(8, 40)).split()
        if kind == "symbols":
            w = [x + "#" * rng.randint(0, 4) for x in w]
        elif kind == "capitals":
            w = [x.upper() if rng.random() < 0.7 else x for x in w]
        elif kind == "lines":
            w += ["\nsame line\n"] * rng.randint(1, 5)
        elif kind == "repeats":
            w += w[:6]
        rows.append((i, " ".join(w), lang))
        if rng.random() < 0.9:
            labels[i] = int(kind == "good") if rng.random() < 0.999 else 1
    rows += [(5000, rows[3][1], rows[3][2]), (5001, None, "en"), (5002, "", None), (5003, rows[4][1], "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for limit in (0.02, 0.2):
        got = sorted((r.doc_id, r.kept) for r in quality_rules.judge(df, marks, limit=limit, level=0.05).collect())
        want = sorted(slow_kept(rows, labels, limit, 0.05))
        assert got == want
    assert 100 < sum(not k for _, k in want) < 1200
