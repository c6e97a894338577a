"""Quality rules on lines: a linear-chain conditional random field labels each line content or boilerplate.

A line is described by what its characters and words are (shares of letters, capitals, digits and symbols, repeated words, its
length, how it ends, whether the text has it before). Neighbouring lines share a transition potential; Viterbi decoding gives the best
labels of all lines of a text together, and the share of words on content lines decides whether the text stays. Counts that need no
model stand beside it: words, symbols, lines seen before, and words in windows that the text repeats.

The field learns by conditional likelihood (forward and backward sums) from labelled texts: lines of good texts are content,
those of poor texts boilerplate at first; then lines of poor texts that look like content by themselves count as content, and it learns
once more. The sample is bounded by about SAMPLE_ROWS texts of each label, chosen by a hash of the id (one text of each id), and SAMPLE_LINES lines of
each, in stretches of STRETCH at hashed places.

Cases: a null or empty text and one without a word has no line, counts of 0 and fails; lines without words are no nodes; texts of
any length and lines of any length are read whole, SLICE characters at a time; without training rows of both labels all lines are
content; repeated rows are labelled alike; labels that are null or for no text teach nothing; an empty table gives an empty table;
other columns stay, those of added names as name_own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import memory, set_aside, widened

#: The least words of a text, the window and largest percentage of repeated words, and the counted symbols.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Share of words on content lines from which a text stays.
LEAST_CONTENT = 0.5
#: Bounds on the training sample: texts of each label, lines of a text, lines of a stretch.
SAMPLE_ROWS, SAMPLE_LINES, STRETCH = 2000, 128, 32
#: Characters described at a time.
SLICE = 1 << 20
#: Steps of learning, and the penalty on squared weights.
STEPS, PENALTY = 150, 1e-4

NEWLINE, SPACE, LETTER, CAPITAL, DIGIT, SYMBOL, END, OTHER = range(8)
FEATURES = ["any", "letters", "capitals", "many capitals", "digits", "symbols", "many symbols", "ends", "marks", "long words", "words", "few words", "repeated words", "many repeated words", "seen before", "closed", "first", "last"]


def _classes() -> np.ndarray:
    """The class of each code point of the first plane; the last one stands for all beyond."""
    table = np.full(1 << 16, OTHER, np.uint8)
    for k in range(len(table) - 1):
        c = chr(k)
        if c.isalpha():
            table[k] = CAPITAL if c.isupper() else LETTER
        elif c.isdigit():
            table[k] = DIGIT
    table[[ord(c) for c in "\t\x0b\x0c\r "]] = SPACE
    table[[ord(c) for c in SYMBOLS]] = SYMBOL
    table[[ord(c) for c in ".!?…。"]] = END
    table[ord("\n")] = NEWLINE
    return table


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` (a power of two) words that occur twice or more: windows are named by
    pairs of names of windows half as long."""
    if len(ids) < window:
        return 0
    name, width = ids.astype(np.int64), 1
    while width < window:
        name = np.unique(name[:-width] * (len(ids) + 1) + name[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(name)[name] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    change[: len(again)] += again
    change[window : window + len(again)] -= again
    return int((np.cumsum(change) > 0).sum())


@dataclass
class Described:
    """A text's counts, and its lines with words: their numbers, words and features."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    lines: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, len(FEATURES))))

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def described(text: str) -> Described:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    if not words:
        return Described()
    classes = memory("linelabels", _classes)
    lines = text.split("\n")
    kinds = np.zeros((len(lines), 8), np.int64)  # characters of each class
    begun, closing = np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)  # words; whether the last character ends a sentence
    line, inside = 0, False
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes[np.minimum(points, len(classes) - 1)]
        of = line + np.cumsum(kind == NEWLINE)
        of -= kind == NEWLINE  # a newline belongs to the line it ends
        high = int(of[-1]) + 1
        kinds[line:high] += np.bincount((of - line) * 8 + kind, minlength=(high - line) * 8).reshape(-1, 8)
        word = kind > SPACE
        begins = word & ~np.concatenate(([inside], word[:-1]))
        begun[line:high] += np.bincount(of[begins] - line, minlength=high - line)
        last = np.flatnonzero(word & ~np.concatenate((word[1:], [False])))  # a word that goes on in the next slice is met there again
        closing[of[last]] = kind[last] == END  # a line's later words overwrite its earlier ones
        inside, line = bool(word[-1]), int(of[-1]) + int(kind[-1] == NEWLINE)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    different = np.bincount(np.unique(np.repeat(np.arange(len(lines)), begun) * len(seen) + ids) // len(seen), minlength=len(lines))
    known: set[str] = set()
    before = np.zeros(len(lines), bool)
    for k in np.flatnonzero(begun).tolist():
        before[k] = lines[k] in known
        known.add(lines[k])
    at = np.flatnonzero(begun)
    of, n = kinds[at], begun[at]
    chars = of[:, LETTER:].sum(axis=1)
    letters = of[:, LETTER] + of[:, CAPITAL]
    share = lambda k: of[:, k] / chars
    capitals, again = of[:, CAPITAL] / np.maximum(letters, 1), 1 - different[at] / n
    columns = [
        np.ones(len(at)), letters / chars, capitals, capitals > 0.5, share(DIGIT), share(SYMBOL), share(SYMBOL) > 0.1, share(END), share(OTHER),
        np.minimum(chars / n, 32) / 32, np.minimum(np.log2(n), 12) / 12, n < 4, again, again > 0.5, before[at], closing[at], np.arange(len(at)) == 0, np.arange(len(at)) == len(at) - 1,
    ]
    total = kinds.sum(axis=0)
    return Described(len(words), int(total[LETTER:].sum()), int(total[SYMBOL]), int(before.sum()), repeated_words(ids), at, n, np.stack(columns, axis=1).astype(float))


@dataclass
class Model:
    """Weights of boilerplate against content (0), and of each label after each."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    after: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def labels(self, features: np.ndarray) -> np.ndarray:
        """The best labels of a text's lines together (Viterbi), boilerplate true; ties are content."""
        own = (features @ self.weights).tolist()
        (cc, cb), (bc, bb) = self.after.tolist()
        content, boiler = 0.0, own[0] if own else 0.0
        came: list[tuple[bool, bool]] = []  # whether the best way to content, and to boilerplate, is from boilerplate
        for score in own[1:]:
            to_content, to_boiler = (content + cc, boiler + bc), (content + cb, boiler + bb)
            came.append((to_content[1] > to_content[0], to_boiler[1] > to_boiler[0]))
            content, boiler = max(to_content), max(to_boiler) + score
        out = np.zeros(len(own), bool)
        now = boiler > content
        for k in range(len(own) - 1, -1, -1):
            out[k] = now
            if k:
                now = came[k - 1][now]
        return out

    def content_share(self, of: Described) -> tuple[float, np.ndarray]:
        """The share of words on content lines, and the numbers of the other lines."""
        if not of.n_words:
            return 0.0, of.lines
        boiler = self.labels(of.features)
        return float(of.words[~boiler].sum() / of.n_words), of.lines[boiler]


def sums(own: np.ndarray, after: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of boilerplate at each place, expected transitions, and log normalisers, of sequences padded to one length; ``own``:
    scores of boilerplate (sequences x places)."""
    count, places = own.shape
    node = np.stack((np.zeros_like(own), own), axis=2)
    live = np.arange(places)[None, :] < length[:, None]
    ahead, back = np.zeros((count, places, 2)), np.zeros((count, places, 2))
    ahead[:, 0] = node[:, 0]
    for t in range(1, places):
        step = np.logaddexp(ahead[:, t - 1, :1] + after[0], ahead[:, t - 1, 1:] + after[1]) + node[:, t]
        ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])  # beyond its end a sequence keeps its last
    for t in range(places - 2, -1, -1):
        come = node[:, t + 1] + back[:, t + 1]
        back[:, t] = np.where(live[:, t + 1, None], np.logaddexp(after[:, 0] + come[:, :1], after[:, 1] + come[:, 1:]), 0)
    norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    boiler = np.exp(ahead[:, :, 1] + back[:, :, 1] - norm[:, None]) * live
    pair = ahead[:, :-1, :, None] + after + (node + back)[:, 1:, None, :] - norm[:, None, None, None]
    moved = (np.exp(pair) * live[:, 1:, None, None]).sum(axis=(0, 1)) if places > 1 else np.zeros((2, 2))
    return boiler, moved, norm


def learned(texts: list[tuple[np.ndarray, bool]]) -> Model:
    """A field from (features of a stretch of lines, whether it is of a poor text)."""
    model = Model()
    if len({poor for _, poor in texts}) < 2:
        return model
    length = np.array([len(x) for x, _ in texts])
    x = np.zeros((len(texts), length.max(), len(FEATURES)))
    for k, (rows, _) in enumerate(texts):
        x[k, : len(rows)] = rows
    live = np.arange(length.max())[None, :] < length[:, None]
    poor = np.array([p for _, p in texts])
    y = live & poor[:, None]
    for turn in range(2):
        # both labels weigh the same, however rare poor texts are
        weight = np.where(poor, 0.5 / max(1, length[poor].sum()), 0.5 / length[~poor].sum())
        weights, after = np.zeros(len(FEATURES)), np.zeros((2, 2))
        state = [np.zeros(len(FEATURES) + 4), np.full(len(FEATURES) + 4, 1e-8)]
        for _ in range(STEPS):
            slope_w, slope_a = np.zeros(len(FEATURES)), np.zeros((2, 2))
            for group in (poor, ~poor):  # one weight each
                boiler, moved, _ = sums(x[group] @ weights, after, length[group])
                w = weight[group][0]
                slope_w += w * np.einsum("stf,st->f", x[group], y[group] - boiler)
                a, b = y[group][:, :-1], y[group][:, 1:]
                both = live[group][:, 1:]
                seen = np.array([[(~a & ~b & both).sum(), (~a & b & both).sum()], [(a & ~b & both).sum(), (a & b & both).sum()]])
                slope_a += w * (seen - moved)
            slope = np.concatenate((slope_w - PENALTY * weights, (slope_a - PENALTY * after).ravel()))
            state[0] = 0.9 * state[0] + 0.1 * slope
            state[1] = 0.99 * state[1] + 0.01 * slope**2
            move = 0.1 * state[0] / np.sqrt(state[1] + 1e-10)
            weights, after = weights + move[:-4], after + move[-4:].reshape(2, 2)
        model = Model(weights, after)
        if turn == 0:
            y = y & (x @ weights > 0)  # lines of poor texts that look like content are content
    return model


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A field from ``docs`` and ``labels`` (key, label: 1 good, 0 poor); see the module for the bounds on the sample."""
    given = labels.filter(F.col(key).isNotNull() & F.col(label_col).isNotNull()).select(F.col(key).alias("k"), (F.col(label_col) == 0).alias("poor")).distinct()
    counts = {r.poor: r.n for r in given.groupBy("poor").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = lambda poor: min(1.0, SAMPLE_ROWS / max(1, counts.get(poor, 0)))
    hashed = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = given.filter(hashed < F.when(F.col("poor"), share(True)).otherwise(share(False)))  # about SAMPLE_ROWS of each label
    texts = docs.select(F.col(key).alias("k"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(chosen), "k")
    sample = texts.groupBy("k", "poor").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "poor")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, poor = [], []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                x = described(text).features.astype(np.float32)
                stretches = [x[k : k + STRETCH] for k in range(0, len(x), STRETCH)]
                drawn = np.random.default_rng(zlib.crc32(text.encode())).permutation(len(stretches))[: SAMPLE_LINES // STRETCH]
                rows += [stretches[k].tobytes() for k in sorted(drawn)]
                poor += [label] * len(drawn)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(poor, pa.bool_())], names=["x", "poor"])

    found = sample.mapInArrow(describe, "x binary, poor boolean").toArrow()  # bounded by the sample
    ordered = sorted(zip(found["x"].to_pylist(), found["poor"].to_pylist()))
    return learned([(np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float), poor) for x, poor in ordered])


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, boilerplate array<int>, kept boolean"


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each text's counts, whether they fail, the share of words on content lines, the numbers (from 0) of
    boilerplate lines, and the verdict."""
    docs = set_aside(docs, *[f.split()[0] for f in ADDED.split(", ")])
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    schema = widened(docs, ADDED)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_()]
        for batch in batches:
            rows = []
            for text in batch.column(names.index(text_col)):
                of = described(text.as_py() or "")
                share, boiler = shared.value.content_share(of)
                rows.append((of.n_words, of.word_chars, of.n_symbols, of.n_dup_lines, of.n_repeat_words, of.failed, share, boiler, not of.failed and share >= LEAST_CONTENT))
            added = [pa.array(list(column), kind) for column, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return docs.mapInArrow(judge, schema)


def filtered(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text stays."""
    own = docs.toDF(*[f"own_{k}" for k in range(len(docs.columns))])
    return judged(own, model, own.columns[docs.columns.index(text_col)]).filter("kept").select(*own.columns).toDF(*docs.columns)
