"""Operator 10: toxicity by a weighted finite-state pattern grammar.

The grammar composes five transducers that read a clause as classes of tokens: insults (words and word starts learned from labels, each with a
weight), threats (a threat verb and then whom it is aimed at), targets (second persons make what is said in their clause weigh more), negation
(weighs less what follows within a few tokens) and reported speech (weighs less the rest of its clause). The composed machine's states are
tuples of the parts' states; its transitions are tabulated once. A document's total is the sum over its matched clauses less `drift` for each
of its words (a share of the rate of insults in toxic documents: a long text has some by chance, as in a Poisson likelihood ratio); its score is the
logistic function of total - cut, with the cut fitted on the labelled sample so that 0.5 separates the labels best.

Insults are learned relationally from a bounded sample of labelled documents: forms (words, and word starts with several endings) that are far
more frequent in toxic documents than in clean ones and that follow many different words there, so that copies of one text teach nothing.

Defined results: a null or empty text has total 0 and the score of that, below 0.5; without any labelled toxic document nothing is learned and only the fixed
threats score; an id whose labels contradict each other teaches nothing, and of several texts under one id the least is learned from; rows that repeat score
alike; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import stage

# The closed classes of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours yourself du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
NEGATIONS = "not no never neither nor without nicht kein keine keinen nie niemals ne pas jamais sans nunca jamás ni sin"
REPORTS = "said says reported reportedly quoted wrote claimed called sagte sagt berichtete schrieb nannte dit disait écrit déclara dijo dice escribió declaró llamó"
THREATS = "kill hurt beat destroy smash shoot stab töten umbringen schlagen zerstören tuer frapper détruire matar golpear destruir"

#: Classes of tokens.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLOSED = {w: c for words, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words.split()}
_TOKEN, _CLAUSE_END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]")
#: Lengths of word starts, and how many endings make one a form.
STARTS, ENDINGS = range(4, 8), 5
#: Choices of the share of the toxic documents' rate of insults that a document must exceed to be toxic, and of the least log odds of a word start by
#: different words, as a share of those asked by number.
PATIENCE, RICH = (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0), (0.0, 1 / 3, 2 / 3)
#: Every so manieth labelled document is for choosing.
INNER = 4


# Transducers: {(state, class): (next state, what it does to the clause's weight)}; state 0 begins, and a missing entry stays and does nothing.
def insults() -> dict:
    return {(0, INSULT): (0, ("add", 1.0))}


def threats(reach: int = 4) -> dict:
    """State n: a threat verb stood n - 1 tokens ago; a target within reach completes it."""
    moves: dict = {(0, THREAT): (1, None)}
    for n in range(1, reach + 1):
        moves |= {(n, c): (n + 1 if n < reach else 0, None) for c in (OTHER, INSULT, NEGATION, REPORT)}
        moves |= {(n, THREAT): (1, None), (n, TARGET): (0, ("add", 3.0))}
    return moves


def targets() -> dict:
    return {(0, TARGET): (1, None), (1, INSULT): (1, ("times", 1.5)), (1, TARGET): (1, None)}


def negation(reach: int = 3) -> dict:
    moves: dict = {(0, NEGATION): (1, None)}
    for n in range(1, reach + 1):
        moves |= {(n, c): (n + 1 if n < reach else 0, ("times", 0.5)) for c in (INSULT, TARGET)}
        moves |= {(n, c): (n + 1 if n < reach else 0, None) for c in (OTHER, THREAT, REPORT)}
        moves[n, NEGATION] = (1, None)
    return moves


def reported() -> dict:
    return {(0, REPORT): (1, None), (1, INSULT): (1, ("times", 0.5)), (1, TARGET): (1, ("times", 0.5)), (1, REPORT): (1, None)}


def compose(*parts: dict) -> dict[tuple[int, int], tuple[int, float]]:
    """One machine that runs all parts side by side: what the adders emit together, times what the others make of it."""
    number, todo, moves = {(0,) * len(parts): 0}, [(0,) * len(parts)], {}
    while todo:
        state = todo.pop()
        for kind in range(6):
            steps = [part.get((s, kind), (s, None)) for part, s in zip(parts, state)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            adds, by = sum(e[1] for _, e in steps if e and e[0] == "add"), math.prod(e[1] for _, e in steps if e and e[0] == "times")
            moves[number[state], kind] = (number[after], adds * by)
    return moves


MACHINE = compose(insults(), threats(), targets(), negation(), reported())


@dataclass
class Grammar:
    """Learned forms with their weights, what each word takes off, and the total at which the score is 0.5."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    drift: float = 0.0
    cut: float = 1.0

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(min(700.0, self.cut - total)))

    def finder(self) -> re.Pattern:
        """Where a clause may match: any insult or threat."""
        forms = sorted([re.escape(w) + r"\b" for w in self.words] + [re.escape(w) for w in self.starts] + [re.escape(w) + r"\b" for w in THREATS.split()])
        return re.compile(r"\b(?:" + "|".join(f"{a}(?:{'|'.join(x[len(a):] for x in group)})" for a, group in ((a, [*g]) for a, g in itertools.groupby(forms, lambda x: x[0]))) + ")")

    def weight(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        return max((self.starts.get(token[:n], 0.0) for n in STARTS if len(token) > n), default=0.0)

    def clause(self, text: str) -> float:
        state, total, said = 0, 0.0, set()
        for token in _TOKEN.findall(text):
            weight = self.weight(token)
            state, emitted = MACHINE[state, INSULT if weight else _CLOSED.get(token, OTHER)]
            if token in said:
                continue  # an insult that a clause repeats counts once
            if weight:
                said.add(token)
            total += emitted * (weight or 1.0)
        return total

    def total(self, text: str | None, finder: re.Pattern) -> float:
        matched, words = self.matched(text, finder)
        return matched - self.drift * words

    def matched(self, text: str | None, finder: re.Pattern) -> tuple[float, int]:
        """The sum over the matched clauses, and the words of which each takes off."""
        if not text:
            return 0.0, 0
        words, total, done = 1 + text.count(" ") + text.count("\n"), 0.0, 0
        text = text.lower()
        for hit in finder.finditer(text):
            if hit.start() < done:
                continue
            ends = max((text.rfind(c, done, hit.start()) for c in ".!?;:\n"), default=-1)
            end = _CLAUSE_END.search(text, hit.end())
            begin, done = max(done, ends + 1), end.end() if end else len(text)
            total += self.clause(text[begin:done])
        return total, words


def _score_batches(grammar: Grammar, drop: float | None = None):
    """Arrow batches with score (a double) added; or, with drop, the batches' own columns without the rows that reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            totals = [grammar.total(t, finder) for t in batch.column("text").to_pylist()]
            scores = pa.array(map(grammar.score, totals), pa.float64())
            if drop is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), scores], [*(c for c in batch.schema.names if c != "text"), "score"])
            else:
                yield batch.filter(pc.less(scores, drop))

    return run


def _pairs(text: str | None) -> set[tuple[str, str]]:
    """Each different (word, word before) of a text."""
    words = _TOKEN.findall((text or "").lower())
    return set(zip(words, ["", *words]))


def _forms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def _toxic_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            rows = [(f, w, p) for w, p in _pairs(text) for f in _forms(w)]
            form, word, before = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"form": pa.array(form, pa.string()), "word": pa.array(word, pa.string()), "before": pa.array(before, pa.string()), "doc_id": pa.array([doc] * len(form), pa.int64())})


def _learn(sample: DataFrame, least: int, odds: float, rich: tuple[float, ...]) -> tuple[list[float], list[Grammar]]:
    """Of a sample (doc_id, text, _toxic), for each choice of rich: the toxic documents' rate of insults, and a grammar without drift and cut."""
    rows = sample.filter("_toxic = 1").mapInArrow(_toxic_forms, "form string, word string, before string, doc_id long")
    seen = rows.groupBy("form").agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("before").alias("contexts"), F.countDistinct("word").alias("endings"))
    n_toxic = sample.filter("_toxic = 1").count()
    often = (F.col("contexts") >= max(least, 0.005 * n_toxic)) & (F.col("contexts") * 2 >= F.col("docs")) & (~F.col("form").endswith("*") | (F.col("endings") >= ENDINGS))
    found = seen.filter(often).collect()  # forms of the bounded sample
    candidates, kinds = {r.form: r.times for r in found}, {r.form: r.endings for r in found}

    def all_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates' counts in clean texts, and under an empty form the count of all pairs by label."""
        for batch in batches:
            for toxic, text in zip(batch.column("_toxic").to_pylist(), batch.column("text").to_pylist()):
                pairs = _pairs(text)
                forms = [] if toxic else [(f, w) for w, _ in pairs for f in _forms(w) if f in candidates]
                form, word = zip(*forms, ("", ""))
                yield pa.RecordBatch.from_pydict({"form": pa.array(form, pa.string()), "word": pa.array(word, pa.string()), "_toxic": pa.array([toxic] * len(form), pa.int32()), "n": pa.array([1] * len(forms) + [len(pairs)], pa.int64())})

    summed = sample.select("_toxic", "text").mapInArrow(all_forms, "form string, word string, _toxic int, n long").groupBy("form", "_toxic").agg(F.sum("n").alias("n"), F.countDistinct("word").alias("kinds")).collect()
    counts = {(r.form, r["_toxic"]): (r.n, r.kinds) for r in summed}
    in_toxic, in_clean = (max(1, counts.get(("", k), (1, 0))[0]) for k in (1, 0))

    def ratio(in_one: int, in_other: int) -> float:
        return math.log((in_one + 0.5) / in_toxic) - math.log((in_other + 0.5) / in_clean)

    weights = {f: (ratio(n, counts.get((f, 0), (0, 0))[0]), ratio(kinds[f], counts.get((f, 0), (0, 0))[1])) for f, n in candidates.items()}
    grammars, rates = [], []
    for share in rich:
        kept = {f: w for f, (w, of_kinds) in weights.items() if w >= odds and (of_kinds >= odds * share or not f.endswith("*"))}
        starts: dict[str, float] = {}
        for f in sorted((f for f in kept if f.endswith("*")), key=lambda f: (len(f), f)):
            if any(f.startswith(s) for s in starts):
                continue
            for longer in sorted((g for g in kept if g.endswith("*") and g.startswith(f[:-1])), key=lambda g: (len(g), g)):
                if candidates[longer] >= 0.98 * candidates[f]:
                    f = longer
            starts[f[:-1]] = kept[f]
        words = {f: w for f, w in kept.items() if not f.endswith("*")}
        own = sum(candidates[s + "*"] for s in starts) + sum(candidates[w] for w in words if not any(w.startswith(s) and len(w) > len(s) for s in starts))
        rates.append(own / in_toxic)
        grammars.append(Grammar(words, starts))
    return rates, grammars


def _matched(sample: DataFrame, grammar: Grammar) -> list[tuple[int, float, int]]:
    """Label, sum of matches and words of each row of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = grammar.finder()
        for batch in batches:
            found = [grammar.matched(t, finder) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array([m for m, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["toxic", "matched", "words"])

    return [tuple(r) for r in sample.select("_toxic", "text").mapInArrow(run, "toxic int, matched double, words long").collect()]


def best_cut(totals: list[tuple[float, int]]) -> float:
    """The cut between two totals at which the shares of toxic documents over it and of clean ones below it are largest together; 0.5 at least."""
    ranked = sorted(totals, reverse=True)
    n_toxic = sum(t for _, t in ranked)
    best, at, hits, false = 0.0, 1.0, 0, 0
    for (total, toxic), (below, _) in zip(ranked, [*ranked[1:], (-math.inf, 0)]):
        hits, false = hits + toxic, false + 1 - toxic
        if total > below and (gain := hits / max(1, n_toxic) - false / max(1, len(ranked) - n_toxic)) > best:
            best, at = gain, (total + below) / 2
    return max(at, 0.5) if math.isfinite(at) else 0.5


def _loss(grammar: Grammar, matched: list[tuple[int, float, int]]) -> tuple[float, float]:
    """Errors at 0.5, and log loss, of each label's share."""
    size = {k: max(1, sum(t == k for t, *_ in matched)) for k in (0, 1)}
    scored = [(toxic, grammar.score(total - grammar.drift * words)) for toxic, total, words in matched]
    errors = sum(((p >= 0.5) != bool(toxic)) / size[toxic] for toxic, p in scored)
    return errors, -sum(math.log(min(1.0, max(1e-9, p if toxic else 1 - p))) / size[toxic] for toxic, p in scored)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, least: int = 4, odds: float = 3.0) -> Grammar:
    """Learn insults, patience and the cut from docs (doc_id, text) labelled by labels (doc_id, toxic).

    per_class bounds the sample: so many documents of each label at most, chosen by hash. A form is learned if it follows at least
    max(least, 0.5 % of the toxic sample) different words and at least half as many as there are toxic documents with it, and if the log of
    its rates' ratio is odds or more; of a word start, the ratio of different words with it must be a chosen share of that. A text counts each pair of
    neighbouring words once. labels holds the rows to learn from and no others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("toxic").cast("int")).alias("_toxic"), F.max(F.col("toxic").cast("int")).alias("_other")).filter("_toxic = _other").drop("_other")
    chosen = [known.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (1, 0)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class ids at most
    sample = stage(docs.join(ids, F.col("doc_id") == F.col("_id")).filter("text is not null").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    if sample.filter("_toxic = 1").isEmpty():
        return Grammar()
    for_choice = F.pmod(F.xxhash64(F.lit("inner"), "doc_id"), F.lit(INNER)) == 0
    inner, outer = sample.filter(~for_choice), sample.filter(for_choice)
    found = []
    rates, grammars = _learn(inner, least, odds, RICH)
    for rich, rate, grammar in zip(RICH, rates, grammars):
        own, other = _matched(inner, grammar), _matched(outer, grammar)
        for patience in PATIENCE:
            grammar.drift = patience * rate
            grammar.cut = best_cut([(m - grammar.drift * n, toxic) for toxic, m, n in own])
            found.append((_loss(grammar, other or own), rich, patience))
    _, rich, patience = min(found)
    (rate,), (grammar,) = _learn(sample, least, odds, (rich,))
    grammar.drift = patience * rate
    grammar.cut = best_cut([(m - grammar.drift * n, toxic) for toxic, m, n in _matched(sample, grammar)])
    return grammar


def score(docs: DataFrame, grammar: Grammar, *columns: str) -> DataFrame:
    """columns of docs and score (0 to 1) for each row, of its whole text."""
    chosen = docs.select(*columns, "text")
    names = [f for f in chosen.schema.fields if f.name != "text"]
    return chosen.mapInArrow(_score_batches(grammar), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", score double")


def without_toxic(docs: DataFrame, grammar: Grammar, at: float = 0.5) -> DataFrame:
    """docs without the rows that score at or more; all columns as they are."""
    return docs.mapInArrow(_score_batches(grammar, at), docs.schema)
