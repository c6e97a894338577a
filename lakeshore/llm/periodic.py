"""Runs of periodic words: stretches that repeat a block of words three times or more, found by probing a harmonic grid.

A run of smallest period q and at least 3 q words holds three successive multiples of q, so a probe of words j q and (j + 1) q for
all j meets every run. For each period p up to a third of the text all multiples of p are probed, which is n / p probes for p and
n log n in all; places between the first two grid points that a run must also repeat thin the survivors out. Each survivor is extended
to both sides by comparing chunks of growing length. Grid points inside a run whose period divides p are skipped: they would find that run
again. Any period that a long stretch has beside its smallest is a multiple of it, so what is left has p as its smallest period.

Cases: a null or empty text has no runs and an empty collapsed text; texts of any length are searched whole, their grid in pieces of
PROBES places, so that memory grows with the text only; equal texts give equal results; an empty table gives an empty table; other columns
stay, those named runs, strongest or collapsed as name_own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import set_aside, widened

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid points probed at a time, words compared first when a survivor is extended, and bytes of text to a batch of results.
PROBES, CHUNK, BATCH_BYTES = 1 << 20, 64, 16 << 20

RUN = "struct<start:long,length:long,period:long>"

Run = tuple[int, int, int]


def numbered_words(words: Sequence[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many items of ``a`` and ``b``, of one length, agree before the first that differs; compared in growing chunks."""
    at, size = 0, CHUNK
    while at < len(a):
        differ = a[at : at + size] != b[at : at + size]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += len(differ)
        size *= 2
    return len(a)


def extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch [start, end) around ``at`` and ``at + period`` in which words ``period`` apart are equal."""
    right = _agree(ids[at : len(ids) - period], ids[at + period :])
    left = _agree(ids[:at][::-1], ids[period : at + period][::-1])
    return at - left, at + right + period


def survivors(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, grid points) in rising order of periods: where the grid's words and those between agree a period on."""
    n, first, short = len(ids), 1, LEAST_WORDS // LEAST_PERIODS
    while LEAST_PERIODS * first <= n:
        # periods from `first` on whose grids fill a piece
        last = min(n // LEAST_PERIODS, first + max(0, PROBES * first // n))
        periods = np.arange(first, last + 1)
        points = (n - 1) // periods
        period = np.repeat(periods, points)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * period
        kept = ids[at] == ids[at + period]
        at, period = at[kept], period[kept]
        small = period < short
        for k in range(1, 9):  # a run's first grid point has at least a whole period after it that is repeated
            place = at + np.maximum(period * k // 8, small)
            kept = place + period < n
            kept[kept] = ids[place[kept]] == ids[place[kept] + period[kept]]
            at, period, small = at[kept], period[kept], small[kept]
        cuts = np.flatnonzero(np.diff(period)) + 1
        if len(at):
            for group in np.split(np.arange(len(at)), cuts):
                p = int(period[group[0]])
                points = at[group]
                for step in range(1, LEAST_WORDS - 2 * p + 1):  # and of a short period all that the shortest run has
                    points = points[points + step + p < n]
                    points = points[ids[points + step] == ids[points + step + p]]
                if len(points):
                    yield p, points
        first = last + 1


def runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[int, list[tuple[int, int]]] = {}  # by period, in rising order of starts
    for p, points in survivors(ids):
        for q, spans in found.items():
            if p % q == 0 and len(points):
                ends = np.array([e for _, e in spans])
                before = np.searchsorted(np.array([s for s, _ in spans]), points, "right") - 1
                # runs of one period overlap by less than it, so only the last that starts before can hold both words
                points = points[(before < 0) | (points + p >= ends[np.maximum(before, 0)])]
        while len(points):
            start, end = extended(ids, int(points[0]), p)
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.setdefault(p, []).append((start, end))
            points = points[points + p >= end]
    return sorted((s, e - s, p) for p, spans in found.items() for s, e in spans)


def strongest(found: Sequence[Run]) -> Run | None:
    """The run of the greatest length / period; of equal ones that of the smallest start, then period."""
    best: Run | None = None
    for run in found:  # in order of start and period: only a greater one takes its place
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: Sequence[bytes], found: Sequence[Run]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not found:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept) if k]


def searched(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with runs (array of start, length, period, in words), strongest (one of them or null) and collapsed: the text's words,
    joined by one space, without those that a run repeats."""
    docs = set_aside(docs, "runs", "strongest", "collapsed")
    names = docs.columns
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, size, all_runs, best, left = 0, 0, [], [], []
            for k, text in enumerate(batch.column(names.index(text_col))):
                raw = (text.as_py() or "").encode()
                words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
                found = runs(numbered_words(words))
                all_runs.append([as_row(r) for r in found])
                best.append(as_row(strongest(found)))
                left.append(b" ".join(collapsed(words, found)).decode())
                size += len(raw)
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    columns = [c.slice(begun, k + 1 - begun) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(left, pa.string())], names=[*names, "runs", "strongest", "collapsed"])
                    begun, size, all_runs, best, left = k + 1, 0, [], [], []

    return docs.mapInArrow(search, widened(docs, f"runs array<{RUN}>, strongest {RUN}, collapsed string"))


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in whose ``text_col`` every tenth text, by a hash of its id, repeats a block of its own words to its end; for
    measuring. Those texts are joined by one space; texts without an id or words stay as they are."""
    own = set_aside(docs, "_h", "_words")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    x = own.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    g, n = F.floor(F.col("_h") / 10), F.nullif(F.size("_words").cast("long"), F.lit(0))
    start = g % n
    period = F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))
    x = x.withColumn("_words", F.when(F.col("_words").isNotNull() & (n > 0), F.struct(F.col("_words").alias("all"), start.alias("a"), period.alias("p"))))
    all_, a, p = F.col("_words.all"), F.col("_words.a"), F.col("_words.p")
    planted = F.array_join(F.transform(all_, lambda w, i: F.when(i < a, w).otherwise(F.get(all_, (a + (i - a) % p).cast("int")))), " ")
    x = x.withColumn(text_col, F.when(F.col("_words").isNotNull(), planted).otherwise(F.col(text_col)))
    return x.select(*own.columns).toDF(*docs.columns)
