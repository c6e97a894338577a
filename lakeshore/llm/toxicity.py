"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat verb, target, negation, reported speech, intent, booster); insult stems and their weights
are learned from labelled texts, the other word lists are fixed. Five transducers are composed into one that reads each clause once: three
mark what stands in a negation's scope, near a target and in reported speech; one matches insults, marked strong in a run or after a
booster; one matches threats, which are an intent and a verb, or a verb and its target, never a verb alone. A clause's score for each kind
of match is the log of its matched weight; a text's features are the logs of the sums of those over its clauses, and its strongest clause;
its score is their logistic, with weights learned for each kind.

Cases: null, empty and matchless texts get the base score; labels of null or unknown documents are ignored, repeated
labels count once and conflicting ones as toxic; without labels the fixed lists and prior weights score; repeated rows are
scored alike; an empty table gives an empty table; other columns stay, those named score or predicted as score_own and predicted_own.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import memory, numbered, set_aside, widened

#: Bound on the labelled texts that are learned from: about so many, chosen by a hash of the id.
SAMPLE_ROWS = 30_000
REJECT = 0.7
STEM, LONGEST = 3, 12
#: Evidence a stem needs: the chance (natural log) that so many of its texts are toxic if it told nothing; share of toxic ones.
EVIDENCE, PRECISION = 13.8, 0.8
#: Share of a stem's texts in which one longer stem stands as well that makes the longer one the stem.
SAME = 0.9

# Fixed word lists.
THREATS = "kill murder hurt shoot stab strangle destroy töte töten umbringen erschießen tuer tuerai frapper matar mataré matarte".split()
TARGETS = "you your yours he him she they them du dich dein deine ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not never no nobody isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split()
INTENTS = "will going gonna i'll we'll shall want werde werden will wollen vais va allons veux voy vamos quiero".split()
BOOSTERS = "such so very total totally absolute absolutely utter complete fucking damn real so sehr total völlig absolut très tellement complètement muy tan completamente".split()
REPORTS = "said says told wrote claimed called quoted sagte sagt schrieb behauptete dit disait écrivit dijo dice escribió".split()

#: A clause's end, or a word with what apostrophes join to it, which is read as one word only where a fixed list has it.
WORDS = re.compile(r"[.!?;:|\n]|[^\W_]+(?:['’][^\W_]+)*")
APOSTROPHES = re.compile("['’]")
SEPARATORS = re.compile(r"[\W_]+")
ENDS = frozenset(".!?;:|\n")

Symbol = tuple[str, ...]


class Transducer:
    """A deterministic letter transducer: arcs by (state, symbol); a symbol without an arc keeps what ``default`` says."""

    def __init__(self, start: object, step) -> None:
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is what the other one reads."""

        def step(state, symbol):
            left, out = self.step(state[0], symbol)
            right, out = other.step(state[1], out)
            return (left, right), out

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: list[Symbol]) -> tuple[int, dict[tuple[int, Symbol], tuple[int, Symbol]]]:
        """All reachable states, numbered, and their arcs over the alphabet."""
        number, todo, arcs = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                after, out = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[number[state], symbol] = (number[after], out)
        return 0, arcs


MATCHED = ("insult", "threat")


def scope(trigger: str, mark: str, reach: int | None) -> Transducer:
    """Marks insults and threat verbs at most ``reach`` words after a trigger (None: up to the clause's end)."""

    def step(left: int, symbol: Symbol) -> tuple[int, Symbol]:
        out = (*symbol, mark) if left and symbol[0] in MATCHED else symbol
        if symbol[0] == trigger:
            return reach or 1, out
        return (left if reach is None else max(0, left - 1)), out

    return Transducer(0, step)


def insults() -> Transducer:
    """Insults, strong after a booster or another insult."""

    def step(strong: bool, symbol: Symbol) -> tuple[bool, Symbol]:
        if symbol[0] == "insult":
            return True, (*symbol, "strong") if strong else symbol
        return symbol[0] == "booster", symbol

    return Transducer(False, step)


def threats(before: int, after: int) -> Transducer:
    """Threats: a verb at most ``before`` words after an intent, or, strong, a target at most ``after`` words after a verb; the
    target puts the match out, with the verb's marks. Any other verb becomes a plain word."""

    def step(state: tuple[int, int, Symbol], symbol: Symbol) -> tuple[tuple[int, int, Symbol], Symbol]:
        intent, left, marks = state
        less = (max(0, intent - 1), max(0, left - 1), marks if left > 1 else ())
        if symbol[0] == "intent":
            return (before, *less[1:]), symbol
        if symbol[0] == "threat":
            return (less[0], after, symbol[1:]), symbol if intent else ("other",)
        if symbol[0] == "target" and left:
            return (less[0], 0, ()), ("threat", *marks, "strong")
        return less, symbol

    return Transducer((0, 0, ()), step)


ALPHABET: list[Symbol] = [("other",), ("insult",), ("threat",), ("target",), ("negation",), ("report",), ("intent",), ("booster",)]
GRAMMAR = scope("negation", "negated", 3).then(scope("target", "aimed", 4)).then(scope("report", "reported", None)).then(insults()).then(threats(4, 3))
START, ARCS = GRAMMAR.compiled(ALPHABET)
KINDS = sorted({out for _, out in ARCS.values() if out[0] in MATCHED})
#: Weights before any label is seen: what is negated or reported tells less; the strongest clause tells nothing of its own.
PRIOR = np.array([1.5 if "negated" in k or "reported" in k else 3.0 for k in KINDS] + [0.0, -4.0])


class Lexicon:
    """Symbols and weights of words: the longest learned stem, else the fixed lists."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.fixed = {w: ("threat", 1.0) for w in THREATS} | {w: ("target", 0.0) for w in TARGETS} | {w: ("negation", 0.0) for w in NEGATIONS} | {w: ("report", 0.0) for w in REPORTS}
        self.fixed |= {w: ("intent", 0.0) for w in INTENTS if w not in self.fixed} | {w: ("booster", 0.0) for w in BOOSTERS if w not in self.fixed}

    def of(self, word: str) -> tuple[str, float]:
        if (found := self.stems.get(word + "$")) is not None:
            return "insult", found
        for n in range(min(len(word), LONGEST), STEM - 1, -1):
            if (found := self.stems.get(word[:n])) is not None:
                return "insult", found
        return self.fixed.get(word, ("other", 0.0))


def tokens(text: str, lexicon: Lexicon) -> Iterator[str]:
    """Words and clause ends. What apostrophes join is split (``l'idiot``) unless a list has it whole (``isn't``), so words are those that
    stems are learned from."""
    for token in WORDS.findall(text):
        if "'" in token or "’" in token:
            whole = token.replace("’", "'")
            yield from (whole,) if whole in lexicon.fixed else APOSTROPHES.split(token)
        else:
            yield token


def clauses(text: str, lexicon: Lexicon) -> Iterator[dict[Symbol, float]]:
    """Matched weights by kind of each clause that has a match."""
    found: dict[Symbol, float] = {}
    state = START
    for token in tokens(text, lexicon):
        if token in ENDS:
            if found:
                yield found
            state, found = START, {}
            continue
        symbol, weight = lexicon.of(token)
        state, out = ARCS[state, (symbol,)]
        if out[0] in MATCHED:
            found[out] = found.get(out, 0.0) + (weight or 1.0)
    if found:
        yield found


def features(found: Iterable[dict[Symbol, float]]) -> np.ndarray:
    """Of a text's clauses: for each kind the log of the clauses' summed scores, then the strongest clause's score, then one."""
    total, peak = dict.fromkeys(KINDS, 0.0), 0.0
    for clause in found:
        scores = {k: math.log1p(w) for k, w in clause.items()}
        peak = max(peak, sum(scores.values()))
        for k, x in scores.items():
            total[k] += x
    return np.array([math.log1p(total[k]) for k in KINDS] + [peak, 1.0])


def stems_of(text: str) -> set[str]:
    """All stems of a text's words, and the words themselves, ended by $."""
    out: set[str] = set()
    for word in set(SEPARATORS.split(text.lower())):
        if len(word) >= STEM:
            out.add(word + "$")
            out.update(word[:n] for n in range(STEM, min(len(word), LONGEST) + 1))
    return out


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray) -> None:
        self.lexicon, self.weights = Lexicon(stems), weights
        self.name = f"stems {uuid.uuid4().hex}"

    def score(self, text: str | None) -> float:
        found: Iterable[dict[Symbol, float]] = ()
        if text:
            lowered = text.lower()
            words = SEPARATORS.split(lowered)
            known: dict[str, bool] = memory(self.name, dict)
            if len(known) > 500_000:
                known.clear()
            hits = list(map(known.get, words, repeat(2)))
            if 2 in hits:
                for w in {w for w, h in zip(words, hits) if h == 2}:
                    known[w] = self.lexicon.of(w)[0] in MATCHED
                hits = list(map(known.__getitem__, words))
            if True in hits:  # else no clause has a match
                found = clauses(lowered, self.lexicon)
        return float(1 / (1 + np.exp(-np.clip(features(found) @ self.weights, -30, 30))))


def _counted(texts: DataFrame) -> DataFrame:
    """(stem, n): how many of the texts have each stem."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0):
                found.update(stems_of(text.as_py()))
            yield pa.RecordBatch.from_pydict({"stem": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return texts.select("text").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learned_stems(sample: DataFrame) -> dict[str, float]:
    """Stems of insults, from (text, toxic): toxic texts propose, all texts count. Stems are counted, held against each other and judged on
    the executors; only those that pass come to the driver."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    share = n_toxic / (n_toxic + n_clean)
    proposed = _counted(sample.filter("toxic = 1")).filter(F.col("n") >= EVIDENCE / -math.log(share))
    clean = _counted(sample.filter("toxic = 0")).withColumnRenamed("n", "c")
    starts = F.transform(F.sequence(F.lit(STEM), F.char_length("stem") - 1), lambda k: F.substring("stem", F.lit(1), k))
    longer = proposed.filter(F.char_length("stem") > STEM).select(F.explode(starts).alias("stem"), "n").groupBy("stem").agg(F.max("n").alias("longer"))
    x = proposed.join(clean, "stem", "left").join(longer, "stem", "left").na.fill(0, ["c", "longer"])
    n, p = F.col("n") + F.col("c"), F.col("n") / (F.col("n") + F.col("c"))
    # bound on minus the log of the chance of at least so many toxic ones by luck
    surprise = n * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    # a stem that nearly always goes on in the same way is no stem, its continuation is
    passed = x.filter((F.col("longer") < SAME * F.col("n")) & (p >= PRECISION) & (p > share) & (surprise >= EVIDENCE))
    good = {r.stem: min(6.0, math.log((r.n + 0.5) / (n_toxic + 1)) - math.log((r.c + 0.5) / (n_clean + 1))) for r in passed.select("stem", "n", "c").collect()}
    # a longer stem says nothing more where a shorter one is as telling
    return {s: w for s, w in good.items() if not any(good.get(s[:k], 0.0) >= w - 1.0 for k in range(STEM, min(len(s), LONGEST + 1)))}


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) over a bounded sample of the labels."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()  # bounded by sample_rows
    try:
        lexicon = Lexicon(learned_stems(sample))

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [features(clauses(t.lower(), lexicon)).tolist() for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

        # alike rows become one: what comes to the driver is bounded by the sample
        table = sample.mapInArrow(describe, "x array<double>, toxic int").groupBy("x", "toxic").count().toArrow()
    finally:
        sample.unpersist()
    weights = PRIOR.copy()
    if table.num_rows:
        x = np.array(table["x"].to_pylist())
        y, n = table["toxic"].to_numpy().astype(float), table["count"].to_numpy().astype(float)
        for _ in range(50):  # Newton's method around the prior
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (n * (y - p)) - (weights - PRIOR)
            move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(PRIOR)), slope)
            weights = weights + np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-8:
                break
    return Model(lexicon.stems, weights)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from REJECT on)."""
    docs = set_aside(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= REJECT) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(score, widened(docs, "score double, predicted int"))


def cleaned(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that are rejected."""
    own = numbered(docs)
    kept = scored(own, model, own.columns[docs.columns.index("text")]).filter("predicted = 0")
    return kept.select(*own.columns).toDF(*docs.columns)
