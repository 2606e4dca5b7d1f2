"""Operator 9: quality rules whose cutoffs hold the rate of false rejections, by exact binomial tests on labelled holdouts.

Each rule is a measure of a text that is worse the higher it is, with a fixed ladder of cutoffs from lenient to strict. For every stratum (a
language) and rule the ladder is tested in that order: H0 is that the cutoff rejects over limit / rules of the good texts, its p-value the exact
binomial P(X <= rejected good texts). The test of a ladder stops at the first cutoff that fails, which costs no level; ladders of all strata
and rules share the level by Bonferroni. So with probability 1 - level no stratum's rules reject over `limit` of its good texts. Of the
certified cutoffs the one with most bad less good texts rejected is used, the lenient one of equals; a ladder with none certified rejects nothing.

No rule is fitted on the labels, so every labelled row is a holdout; copies count once, since the test supposes independent texts. Ladders
are counted by groupBy to rows of (stratum, rule, step), and judged stratum by stratum.

Defined results: null and empty texts have no words, all measures 0, and fail the base rule; a null stratum is one of its own; a label without a document
or a null label teaches nothing; rows that repeat are judged alike; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import Texts, grams, mix, stage, texts

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
#: Cutoffs of each ladder, lenient to strict.
LADDER = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02)
#: Strata up to which their cutoffs are broadcast (some hundred bytes each).
FEW = 10_000


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """Each rule's measure."""
    return {"symbols": _share("n_symbols", "word_chars"), "repeats": _share("n_repeat_words", "n_words"), "dup_lines": _share("n_dup_lines", "n_lines"), "capitals": _share("n_capitals", "word_chars")}


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _measured(t: Texts) -> list[np.ndarray]:
    words = t.hashes()
    ends = t.ends()
    start = np.flatnonzero(np.arange(len(words)) + WINDOW <= ends)
    row = t.row_of_word()
    covered = np.zeros(len(words) + 1, np.int64)
    if len(start):
        key = mix(grams(words, WINDOW)[start] ^ mix(row[start].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        ranked = key[order]
        twin = np.zeros(len(key), bool)
        equal = ranked[1:] == ranked[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        again = start[order[twin]]
        covered[again] += 1
        covered[again + WINDOW] -= 1
    repeated = np.cumsum(covered)[:-1] > 0
    in_words = np.zeros(len(t.data) + 1, np.int64)
    in_words[t.start] += 1
    np.subtract.at(in_words, t.end, 1)
    inside = np.cumsum(in_words)[:-1] > 0
    return [np.diff(t.word_at), t.sums(inside & ((t.data & 0xC0) != 0x80)), t.sums(_SYMBOL[t.data]), np.bincount(row[repeated], minlength=t.rows), t.sums(_CAPITAL[t.data])]


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(docs: DataFrame, *columns: str) -> DataFrame:
    """columns of docs and the measures of each row's whole text."""
    chosen = docs.select(*columns, "text")
    kept = [f for f in chosen.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            parts = [_measured(t) for t in texts(column)]
            words, chars, symbols, repeated, capitals = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
            lines = np.array([_lines(x.as_py()) for x in column], np.int64).reshape(-1, 2)
            found = dict(zip(MEASURES, (words, chars, symbols, lines[:, 1], repeated, lines[:, 0], capitals)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], [*(f.name for f in kept), *MEASURES])

    return chosen.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{m} long" for m in MEASURES)]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(log).sum()))


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k of n were seen."""
    low, high = (k / n if n else 0.0), 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if k < n and mid < 1 and at_most(k, n, mid) > level else (low, mid)
    return high if k < n else 1.0


def cutoff(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> tuple[float | None, float | None]:
    """The cutoff of a ladder and its rate's upper bound; good[i], bad[i]: texts over exactly i cutoffs, which are the i strictest."""
    n = int(good.sum())
    best, chosen, bound = 0, None, None
    for i, value in enumerate(LADDER):
        lost, caught = int(good[len(LADDER) - i :].sum()), int(bad[len(LADDER) - i :].sum())
        if lost > n * limit or at_most(lost, n, limit) > level:
            break
        if caught - lost > best:
            best, chosen, bound = caught - lost, value, upper_bound(lost, n, level)
    return chosen, bound


def calibrate(measured: DataFrame, limit: float = 0.02, level: float = 0.05) -> DataFrame:
    """stratum, and a column cutoff_<rule> (null: reject nothing) and bound_<rule> for each rule.

    measured: stratum, text_key (equal for equal texts), quality (1 good, 0 bad) and the measures, of labelled rows.
    """
    names = list(rules())
    one = measured.filter("quality is not null").groupBy("stratum", "text_key").agg(F.max("quality").alias("quality"), *[F.max(m).alias(m) for m in MEASURES])
    step = lambda c: sum(((c > x).cast("int") for x in LADDER), F.lit(0))
    steps = one.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), step(c).alias("step")) for n, c in rules().items()])).alias("x"))
    ladders = stage(steps.groupBy("stratum", "x.rule", "x.step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")), "rules-ladders")
    tests = max(1, ladders.select("stratum").distinct().count()) * len(names)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        found = {"stratum": rows["stratum"].iloc[0]}
        for name in names:
            own = rows[rows["rule"] == name]
            good, bad = np.zeros(len(LADDER) + 1, np.int64), np.zeros(len(LADDER) + 1, np.int64)
            good[own["step"]], bad[own["step"]] = own["good"], own["bad"]
            found[f"cutoff_{name}"], found[f"bound_{name}"] = cutoff(good, bad, limit / len(names), level / tests)
        return pd.DataFrame([found])

    return stage(ladders.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"cutoff_{n} double, bound_{n} double" for n in names)), "rules-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02, level: float = 0.05) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, failed (names of the rules failed) and kept of each row of docs (doc_id, text and the stratum's column).

    labels: doc_id, quality. base_failed needs no labels; kept is false if it or a calibrated rule fails.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    measured = stage(measure(rows, "doc_id", "stratum", "text_key"), "rules-measures")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id is not null and quality is not null").groupBy("_id").agg(F.min("quality").alias("quality"))
    cuts = calibrate(measured.join(known, F.col("doc_id") == F.col("_id")).drop("_id"), limit, level)
    cuts = F.broadcast(cuts) if cuts.count() <= FEW else cuts
    judged = measured.join(cuts, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(value > F.col(f"cutoff_{n}"), F.lit(n)) for n, value in rules().items()]))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return judged.select("doc_id", F.nullif("stratum", F.lit("\0")).alias("stratum"), *MEASURES, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
