"""Language identification by prediction by partial matching with frozen statistics.

Each language has a tree of byte contexts up to ORDER bytes. The code length of a byte is that of its count in the
longest context seen, or that context's escape (method C) and the code length in the next shorter one, down to a uniform
byte. Statistics are frozen after training, so a byte's code length depends on ORDER + 1 bytes only: tables are made
once, and texts are scored by looking up all their positions at once. The language of the shortest code wins.

Training counts come from whole labelled texts, at most about SAMPLE_ROWS of each language (chosen by a hash of the
text), counted on the executors.

Cases: a null text or one without a letter is ``und`` with score 0; without any training row all are; ties go to the
first language by name; null languages aren't learned; repeated rows are scored alike; other columns stay, those of added names as name_own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import set_aside, widened

ORDER = 3
#: Bound on the training sample: about so many texts of each language.
SAMPLE_ROWS = 2000
#: Letters, and numerals such as ² or Ⅷ, which are none.
WORD_CHAR = re.compile(r"[^\W\d_]")
#: Languages up to which their row counts are broadcast.
BROADCAST_LANGS = 10_000
#: Bytes scored at a time.
SLICE = 1 << 19


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes that end at each place from n - 1 on, as numbers."""
    size = max(0, len(data) - n + 1)
    out = np.zeros(size, np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | data[k : k + size]
    return out


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORD_CHAR.finditer(text))


def _lead(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text.encode().lower(), np.uint8)


def trained(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, gram, n): counts of all ORDER + 1 byte strings in the sample of ``docs`` (text, lang)."""
    rows = docs.filter("text is not null and lang is not null").select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    if sizes.count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(sizes, "lang").filter(hashed * F.col("rows") < sample_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(_lead(text), ORDER + 1))
            for lang, parts in by.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Numbers to row numbers, for many at once: tables with one slot for each hash, what collides goes to the next table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.uint32)
        self.tables: list[tuple[np.uint32, np.uint32, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        k = 0
        while len(left):
            factor, shift = np.uint32((2654435761 + 2 * 40503 * k * (k + 1)) & 0xFFFFFFFF | 1), np.uint32(32 - bits)
            slot = (self.keys[left] * factor) >> shift
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = left
            self.tables.append((factor, shift, table))
            left = left[table[slot] != left]
            k += 1

    def rows(self, asked: np.ndarray) -> np.ndarray:
        """The row of each number, -1 if there is none."""
        out = np.full(len(asked), -1, np.int32)
        open_ = None
        for factor, shift, table in self.tables:
            part = asked if open_ is None else asked[open_]
            row = table[(part * factor) >> shift]
            hit = (row >= 0) & (self.keys[row] == part)
            if open_ is None:
                out = np.where(hit, row, -1).astype(np.int32)
                open_ = np.flatnonzero(~hit & (row >= 0))
            else:
                out[open_[hit]] = row[hit]
                open_ = open_[~hit & (row >= 0)]
            if not len(open_):
                break
        return out


class Model:
    """Code lengths (bits) of the next byte for all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        many = len(self.langs)
        #: By number of bytes: the strings seen in any language, their code lengths, and the escapes of contexts.
        self.lookup: list[Lookup] = []
        self.bits: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for size in range(1, ORDER + 2) if counts else ():
            each = []
            for lang in self.langs:
                found, n = counts[lang]
                keys, at = np.unique(found & np.uint32((1 << 8 * size) - 1), return_inverse=True)
                each.append((keys, np.bincount(at, n, len(keys))))
            seen = np.unique(np.concatenate([k for k, _ in each]))
            heads = np.unique(seen >> np.uint32(8))  # contexts: the strings without their last byte
            escape = np.zeros((len(heads), many), np.float32)
            bits = np.zeros((len(seen), many), np.float32)
            head_of = np.searchsorted(heads, seen >> np.uint32(8))
            shorter = self._shorter(seen, size, many)
            for k, (keys, n) in enumerate(each):
                own_head = np.searchsorted(heads, keys >> np.uint32(8))
                total, kinds = np.bincount(own_head, n, len(heads)), np.bincount(own_head, minlength=len(heads))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, k] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                bits[:, k] = escape[head_of, k] + shorter[:, k]
                at = np.searchsorted(seen, keys)
                bits[at, k] = -np.log2(n / (total + kinds)[own_head])
            self.lookup.append(Lookup(seen))
            self.bits.append(bits)
            self.escapes.append((Lookup(heads), escape))

    def _shorter(self, strings: np.ndarray, size: int, many: int) -> np.ndarray:
        if size == 1:
            return np.full((len(strings), many), 8.0, np.float32)
        return self.cost(strings & np.uint32((1 << 8 * (size - 1)) - 1), size - 1)

    def cost(self, strings: np.ndarray, size: int) -> np.ndarray:
        """Code lengths of the last byte of each string after its first ``size`` - 1 bytes."""
        row = self.lookup[size - 1].rows(strings)
        out = self.bits[size - 1][row]
        if len(miss := np.flatnonzero(row < 0)):
            part = strings[miss]
            lookup, escape = self.escapes[size - 1]
            head = lookup.rows(part >> np.uint32(8))
            out[miss] = np.where(head[:, None] >= 0, escape[head], 0) + self._shorter(part, size, len(self.langs))
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Total code length of each text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        held, ends, owners = [], [], []

        def score() -> None:
            at = np.concatenate(([0], np.cumsum(ends)[:-1]))
            np.add.at(total, owners, np.add.reduceat(self.cost(np.concatenate(held), ORDER + 1), at, axis=0, dtype=np.float64))
            held.clear(), ends.clear(), owners.clear()

        for k, text in enumerate(texts):
            data = _lead(text)
            for a in range(0, len(data) - ORDER, SLICE):
                part = grams(data[a : a + SLICE + ORDER], ORDER + 1)
                held.append(part)
                ends.append(len(part))
                owners.append(k)
                if sum(ends) >= SLICE:
                    score()
        if held:
            score()
        return total


def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of ``docs`` (text, lang); what comes to the driver is bounded by the sample."""
    table = trained(docs, sample_rows).toArrow()
    lang, gram, n = table["lang"].to_numpy(), table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy()
    return Model({x: (gram[lang == x], n[lang == x]) for x in dict.fromkeys(lang)})


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: the winner's share, sharpness by code length to the power of 1/2)."""
    docs = set_aside(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(names.index("text")).to_pylist()
                good = [k for k, t in enumerate(texts) if model.langs and t and has_letter(t)]
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                bits = model.lengths([texts[k] for k in good]) if good else []
                for k, row in zip(good, bits):
                    best = int(np.argmin(row))
                    share = np.exp2(-(row - row[best]) / max(1.0, np.sqrt(row[best]) / 8))
                    pred[k], score[k] = model.langs[best], float(1 / share.sum())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, widened(docs, "lang_pred string, score double"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))
