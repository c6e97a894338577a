"""Benchmark decontamination by a generalised suffix automaton over the words of normalised test items.

Items are dealt to blocks of bounded size; a Spark task builds each block's automaton and publishes it in the shared
folder. Documents are streamed once: the automaton keeps the longest match that ends at each word, and every
match of a window's length covers its words. A stretch of words without an item's word pair is skipped: no window
can cross it.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Cases: null or wordless texts have no words and no hits; null or wordless items have no windows; a null item id gives
hits, but isn't counted or listed; equal items all count; repeated documents keep their rows; other columns stay, one named leak as leak_own.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import new_folder, numbered, opened, publish, set_aside, widened

WINDOW = 10
#: Words of items to an automaton: bounds what a worker holds at a time.
BLOCK_WORDS = 100_000
WORD_BYTES = bytes(k for k in range(256) if 0x30 <= k <= 0x39 or 0x61 <= k <= 0x7A or k >= 0x80)
LOWERED = bytes(k + 32 if 0x41 <= k <= 0x5A else k if k in WORD_BYTES else 0x20 for k in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWERED).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(x for _, x in items)))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary[w] for w in x]) for item, x in items if x]
        for _, x in coded:
            last = 0
            for w in x:
                last = self._extend(last, w)
        self.window = window
        #: The suffix of a state's strings that has a window's length.
        self.base = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.base[v] = v if self.length[self.link[v]] < window else self.base[self.link[v]]
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        pairs: set[int] = set()
        for item, x in coded:
            state = 0
            pairs.update(a * len(self.vocabulary) + b for a, b in zip(x, x[1:]))
            for k, w in enumerate(x):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items.setdefault(self.base[state], set()).add(item)
            if len(x) < window:
                while self.length[self.link[state]] >= len(x):
                    state = self.link[state]
                self.short.setdefault(state, {}).setdefault(len(x), set()).add(item)
        #: The next state with short items, along suffix links from a state on.
        self.shorter = [-1] * len(self.link)
        if self.short:
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.shorter[v] = v if v in self.short else self.shorter[self.link[v]]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *(len(x) for _, x in coded)])

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered [start, end) ranges of word numbers, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        if not known.any():
            return [], set()
        code = ids[:-1] * len(self.vocabulary) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        joined = known[:-1] & known[1:] & (self.pairs[at] == code) if len(self.pairs) else np.zeros(len(code), bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + 1
        if self.least <= 1:
            alone = np.flatnonzero(known & ~np.concatenate(([False], joined)) & ~np.concatenate((joined, [False])))
            starts, ends = np.concatenate((starts, alone)), np.concatenate((ends, alone + 1))
        long = ends - starts >= self.least
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self._run(ids[a:b].tolist(), a, ranges, items)
        return ranges, items

    def _run(self, ids: list[int], at: int, ranges: list[tuple[int, int]], items: set) -> None:
        follow, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for k, w in enumerate(ids, at + 1):
            while state and w not in follow[state]:
                state = link[state]
                size = length[state]
            if w in follow[state]:
                state, size = follow[state][w], size + 1
            if size >= window:
                ranges.append((k - size, k))
                items |= self.items[self.base[state]]
            if self.short:
                v = self.shorter[state]
                while v > 0:
                    for n, own in self.short[v].items():
                        if n <= size:
                            ranges.append((k - n, k))
                            items |= own
                    v = self.shorter[link[v]]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Build and publish the automata of all items; returns their files, one for each block."""
    folder = new_folder(benchmark.sparkSession, "automata")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        uri = f"{folder}/block-{key[0].as_py():06d}"
        rows = sorted(zip(table.column("item").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        found = Automaton([(i, words_of(t)) for i, t in rows], window)
        publish(uri, lambda out: out.write(pickle.dumps(found, 5)))
        return pa.table({"uri": [uri]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    return sorted(r.uri for r in dealt.groupBy("block").applyInArrow(build, "uri string").collect())


#: Text that meets a block of items together, where there are several blocks.
HELD_BYTES = 32 << 20
_held: dict[str, Automaton] = {}


def _automaton(uri: str) -> Automaton:
    """One automaton at a time stays in a worker."""
    if uri not in _held:
        with opened(uri) as file:
            found = pickle.loads(file.read())
        _held.clear()
        _held[uri] = found
    return _held[uri]


SPANS = "array<struct<start:long,end:long>>"
FIELDS = ["n_words", "n_hit", "items", "spans", "kept_text"]
LEAK = f"leak struct<n_words:long,n_hit:long,items:array<string>,spans:{SPANS},kept_text:string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, text_col: str = "text", keep_text: bool = True, **how) -> DataFrame:
    """``docs`` with struct ``leak``: n_words, n_hit, the items (sorted), the covered spans (word numbers, end
    exclusive) and, with ``keep_text``, the text without its spans of at least ``min_span`` words."""
    docs = set_aside(docs, "leak")
    uris = automata(benchmark, window, **how)
    names = docs.columns

    def without(text: str, spans: list[tuple[int, int]]) -> str:
        raw = text.encode()
        places = [m.span() for m in WORD.finditer(raw)]
        kept, at = [], 0
        for a, b in spans:
            if b - a >= min_span:
                kept.append(raw[at : places[a][0]])
                at = places[b - 1][1]
        return b"".join([*kept, raw[at:]]).decode()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches of about HELD_BYTES of text together: each block's automaton is loaded once for all of them."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(names.index(text_col)).nbytes
            if len(uris) == 1 or size >= HELD_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches):
            texts = [t for batch in group for t in batch.column(names.index(text_col))]
            n_words = [0] * len(texts)
            ranges: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for uri in uris:
                automaton = _automaton(uri)
                for k, text in enumerate(texts):
                    words = words_of(text.as_py())
                    n_words[k] = len(words)
                    if words:
                        more, own = automaton.matches(words)
                        if more:
                            ranges[k] = merged(ranges[k] + more)
                            items[k] |= own
            at = 0
            for batch in group:
                yield leaks(batch, range(at, at + batch.num_rows), texts, n_words, ranges, items)
                at += batch.num_rows

    def leaks(batch: pa.RecordBatch, rows: range, texts: list, n_words: list[int], ranges: list[list], items: list[set]) -> pa.RecordBatch:
        kept = [texts[k].as_py() if keep_text else None for k in rows]
        if keep_text:
            kept = [without(t, ranges[k]) if ranges[k] else t for t, k in zip(kept, rows)]
        columns = [
            pa.array([n_words[k] for k in rows], pa.int64()),
            pa.array([sum(b - a for a, b in ranges[k]) for k in rows], pa.int64()),
            pa.array([sorted(i for i in items[k] if i is not None) for k in rows], pa.list_(pa.string())),
            pa.array([[{"start": a, "end": b} for a, b in ranges[k]] for k in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(kept, pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names=FIELDS)], names=[*names, "leak"])

    if not uris:
        none = F.when(F.col(text_col).isNotNull(), F.size(F.regexp_extract_all(text_col, F.lit(r"([0-9A-Za-z\x{80}-\x{10ffff}]+)"), F.lit(1)))).otherwise(0).cast("long")
        empty = F.struct(none.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("spans"), F.col(text_col).alias("kept_text"))
        return docs.withColumn("leak", empty)
    return docs.mapInArrow(search, widened(docs, LEAK))


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` without covered spans; documents of which more than ``max_coverage`` of the words are covered go whole."""
    own = numbered(docs)
    place = dict(zip(docs.columns, own.columns))
    text, size = place["text"], place.get("n_chars")
    x = contamination(own, benchmark, text_col=text, **how).filter(F.col("leak.n_hit") <= F.col("leak.n_words") * max_coverage)
    x = x.withColumn(text, F.col("leak.kept_text"))
    if size:
        x = x.withColumn(size, F.when(F.col("leak.n_hit") > 0, F.char_length(text).cast(own.schema[size].dataType)).otherwise(F.col(size)))
    return x.select(*own.columns).toDF(*docs.columns)


