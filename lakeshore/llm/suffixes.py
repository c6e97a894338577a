"""Suffix-array deduplication: remove every byte under a string of LENGTH bytes that starts anywhere else as well.

Spreading the work: a string of LENGTH bytes belongs to the smallest hash of its GRAM-byte parts (its anchor), so equal
strings meet under one anchor. A text is cut into pieces: runs of strings with one anchor. Only pieces whose anchor
occurs twice are sorted; equal pieces become one with a count, and all strings of a piece that occurs twice are repeats. So only
pieces that occur once are looked into, and each of those has one place: what it holds of strings that occur nowhere else goes
straight to its text, and no piece is joined with its copies. Each task sorts the suffixes of some anchors' pieces in
two stages: only suffixes smaller than their successors are sorted directly, the rest are induced by bucket scans;
neighbours with a common prefix of LENGTH bytes are repeats. Anchors with too many different pieces are cut again by
longer parts, at last by whole strings, so no task gets an unbounded anchor.

Cases: a null text is empty; texts under LENGTH bytes keep all; equal texts of at least LENGTH bytes are removed
whole, each of them; overlaps within a text count; null or repeated ids are kept as they are, a row each; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import staged

LENGTH = 400
#: Lengths of the parts that are hashed; the next one is for anchors whose different pieces exceed ANCHOR_BYTES.
GRAMS = (200, 320, 380, 400)
ANCHOR_BYTES = 1 << 20
#: Strings looked at together in a text, and bytes whose suffixes are sorted together (whole anchors).
SEGMENT, SORTED_BYTES = 1 << 20, 1 << 20
#: Bytes to a named block of text: three times the seven bytes that one number holds.
BLOCK = 21
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 2 * LENGTH)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, gram: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the string that starts at each place, and whether the string holds it more than once.

    It is the hash of the leftmost part whose hash has the smallest upper bits. At most 2 ** 21 bytes.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)))
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 21) - 1)
    upper, place = h & ~low, np.arange(len(h), dtype=np.uint64)
    left = _least(upper | place, length - gram + 1) & low
    right = low - (_least(upper | (low - place), length - gram + 1) & low)
    return h[left], left != right


def pieces(raw: bytes, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, first strings, numbers of strings, may a string recur within?) of a text's pieces, a segment at a time."""
    for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
        found, twice = anchors(np.frombuffer(raw, np.uint8, min(SEGMENT + LENGTH - 1, len(raw) - at), at), gram)
        first = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
        many = np.diff(np.append(first, len(found)))
        recurs = np.logical_or.reduceat(twice, first) | (many > LENGTH - gram + 1)
        yield found[first].view(np.int64), at + first, many, recurs


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def _block_names(data: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of the BLOCK bytes from each place on; what lies past the end is smaller than any byte."""
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(2 * BLOCK, np.uint64)))
    seven = np.zeros(n + BLOCK, np.uint64)
    for k in range(7):
        seven = (seven << np.uint64(9)) | padded[k : k + n + BLOCK]
    return _names(_three(_names(seven), np.arange(n), 7)) + np.uint64(1)


def _three(names: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Three names, ``step`` apart, as one number; equal and ordered as they are, among what is asked for together."""
    if not len(names) or names.max() < 1 << 21:
        return (names[at] << np.uint64(42)) | (names[at + step] << np.uint64(21)) | names[at + 2 * step]
    return (_names((names[at] << np.uint64(32)) | names[at + step]) << np.uint64(32)) | names[at + 2 * step]


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later; the empty suffix is the smallest."""
    n = len(data)
    change = np.append(data[1:] != data[:-1], True)
    ends = np.flatnonzero(change)  # the last place of each run of one byte
    rises = np.append(data[ends[:-1]] < data[ends[:-1] + 1], False)
    return rises[np.searchsorted(ends, np.arange(n))]


def suffix_order(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, names): all suffixes in order of their first ``length`` bytes, and the names of their blocks."""
    n = len(data)
    small = smaller_than_next(data)
    names = _block_names(data)
    padded = np.concatenate((names, np.zeros(length + 4 * BLOCK, np.uint64)))

    # stage one: sort the smaller suffixes directly, three blocks a round, as long as they tie
    order = np.flatnonzero(small)
    group = np.zeros(len(order), np.int64)
    open_ = np.arange(len(order))
    for depth in range(0, length, 3 * BLOCK):
        if not len(open_):
            break
        key = _three(padded, order[open_] + depth, BLOCK)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_[by]]
        key, own = key[by], group[open_]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]

    # stage two: scan the buckets of first bytes upwards; each scanned suffix places its larger predecessor
    counts = np.bincount(data[order], minlength=256)
    directly = np.split(order, np.cumsum(counts)[:-1])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # placed by the empty suffix
    out = []
    for byte in range(256):
        induced = []
        fresh = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(fresh):
            induced.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[~small[before] & (data[before] == byte)]
        both = np.concatenate([*induced, directly[byte]])
        out.append(both)
        before = both[both > 0] - 1
        before = before[~small[before] & (data[before] > byte)]
        if len(before):
            bucket = data[before]
            by = np.argsort(bucket, kind="stable")
            before, bucket = before[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for part, k in zip(np.split(before, cuts), bucket[np.concatenate(([0], cuts))]):
                waiting[k].append(part)
    return np.concatenate(out), names


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``starts`` (boolean, where whole strings start) share their string with another one."""
    order, names = suffix_order(data, length)
    order = order[starts[order]]
    left = np.arange(len(order) - 1)
    for depth in [*range(0, length - BLOCK, BLOCK), length - BLOCK]:  # neighbours' common prefix, a block at a time
        left = left[names[order[left] + depth] == names[order[left + 1] + depth]]
    found = np.zeros(len(data), bool)
    found[order[left]] = found[order[left + 1]] = True
    return found


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, quick, digest, n_bytes, sha256, anchors) of each row; quick is a hash that Spark can join by."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [x.as_py() or b"" for x in part.column(2)]
                # an anchor counts twice where its piece may hold a string twice
                found = [[np.repeat(a, 1 + twice) for a, _, _, twice in pieces(x, GRAMS[0])] for x in raw]
                lists = pa.array([np.concatenate(x) if x else np.zeros(0, np.int64) for x in found], pa.list_(pa.int64()))
                columns = [part.column(0), part.column(1), pa.array(list(map(xxhash.xxh3_128_digest, raw)), pa.binary()), pa.array(list(map(len, raw)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quick", "digest", "n_bytes", "sha256", "anchors"])

    return docs.select("doc_id", "quick", "raw").mapInArrow(sign, "doc_id long, quick long, digest binary, n_bytes long, sha256 string, anchors array<long>")


PIECES = "anchor long, text long, start long, strings long, piece_key binary, piece binary, weight long"
RANGES = "array<struct<start:long,end:long>>"


def _cut(texts: DataFrame) -> DataFrame:
    """The pieces of ``texts`` (text, weight, anchors, raw) whose anchors are listed; text is a number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, weight, listed, raw = (batch.column(c)[k] for c in range(4))
                raw, wanted = raw.as_py(), listed.values.to_numpy()
                for anchor, first, many, _ in pieces(raw, GRAMS[0]):
                    own = np.isin(anchor, wanted)
                    yield _piece_rows(anchor[own], [text.as_py()] * int(own.sum()), first[own], [raw[a : a + n + LENGTH - 1] for a, n in zip(first[own].tolist(), many[own].tolist())], [weight.as_py()] * int(own.sum()))

    return texts.select("text", "weight", "anchors", "raw").mapInArrow(cut, PIECES)


def _piece_rows(anchor, text, start, piece, weight) -> pa.RecordBatch:
    keys, strings = list(map(xxhash.xxh3_128_digest, piece)), [len(p) - LENGTH + 1 for p in piece]
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(anchor), long(text), long(start), long(strings), pa.array(keys, pa.binary()), pa.array(piece, pa.binary()), long(weight)], names=["anchor", "text", "start", "strings", "piece_key", "piece", "weight"])


def _cut_again(distinct: DataFrame, gram: int) -> DataFrame:
    """Pieces of the different pieces (text, start, piece, weight), by longer parts, with their places in the text; those of a piece that
    occurs more than once have no place of their own, and need none.

    By whole strings, a piece of several strings repeats one byte, so all of them recur: it gets an anchor of its own
    length, and counts twice; its string also stands alone, for texts that hold it once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, start, piece, weight = (batch.column(c)[k].as_py() for c in range(4))
                for anchor, first, many, _ in pieces(piece, gram):
                    weights = np.full(len(anchor), weight)
                    if gram == LENGTH and (runs := many > 1).any():
                        yield _piece_rows(anchor[runs], [text] * int(runs.sum()), start + first[runs], [piece[k : k + LENGTH] for k in first[runs].tolist()], [2] * int(runs.sum()))
                        anchor, weights = np.where(runs, anchor ^ many * 0x5851F42D4C957F2D, anchor), np.where(runs, 2, weights)
                    yield _piece_rows(anchor, [text] * len(anchor), start + first, [piece[k : k + n + LENGTH - 1] for k, n in zip(first.tolist(), many.tolist())], weights)

    return distinct.select("text", "start", "piece", "weight").mapInArrow(cut, PIECES)


def _alone(distinct: DataFrame) -> DataFrame:
    """(text, ranges): where in their texts strings start that occur nowhere else, of the different pieces (anchor, text, start, piece, weight)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            texts, alone = [], []
            n_of: dict[int, int] = {}
            for anchor, *_ in rows:
                n_of[anchor] = n_of.get(anchor, 0) + 1
            sorted_ = [n_of[r[0]] > 1 or r[4] == 1 for r in rows]  # else all copies of one piece
            sort_ = [r for r, own in zip(rows, sorted_) if own]
            found = np.zeros(0, bool)
            if sort_:
                data = np.frombuffer(b"".join(r[3] + b"\xff" for r in sort_), np.uint8)  # no UTF-8 text has this byte
                starts, at = np.zeros(len(data), bool), 0
                for r in sort_:
                    starts[at : at + len(r[3]) - LENGTH + 1] = True
                    at += len(r[3]) + 1
                found = repeated_starts(data, starts)
            at = 0
            for (_, text, start, piece, weight), among in zip(rows, sorted_):
                own = found[at : at + len(piece) - LENGTH + 1]
                at += (len(piece) + 1) * among
                if weight == 1 and not own.all():
                    texts.append(text)
                    alone.append([{"start": start + a, "end": start + b} for a, b in ranges_of(~own)])
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(alone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["text", "ranges"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(batch.column(c)[k].as_py() for c in range(5))
                if size >= SORTED_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done(held)

    own = distinct.select("anchor", "text", "start", "piece", "weight").repartition("anchor").sortWithinPartitions("anchor")
    return own.mapInArrow(sort, f"text long, ranges {RANGES}")


def _spans(listed: DataFrame, alone: DataFrame) -> DataFrame:
    """(text, spans): the bytes to remove of each text, from where its listed strings start, and those among them that occur nowhere else."""

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for k in range(batch.num_rows):
                of = [(x["alone"], r["start"], r["end"]) for x in batch.column(1)[k].as_py() for r in x["ranges"]]
                flags = np.zeros(max(end for _, _, end in of), bool)
                for once, start, end in sorted(of):  # listed ones first
                    flags[start:end] = not once
                if flags.any():
                    texts.append(batch.column(0)[k].as_py())
                    spans.append([{"start": a, "end": b + LENGTH - 1} for a, b in ranges_of(flags)])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["text", "spans"])

    both = listed.select("text", F.lit(False).alias("alone"), "ranges").unionByName(alone.select("text", F.lit(True).alias("alone"), "ranges"))
    return both.groupBy("text").agg(F.collect_list(F.struct("alone", "ranges")).alias("of")).mapInArrow(covered, f"text long, spans {RANGES}")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, partly): (doc_id, digest, n_bytes, sha256) of each row; (digest, copies) of the different texts of at
    least LENGTH bytes; and (digest, raw, spans) of those without copies that have bytes to remove."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    source = source.withColumn("quick", F.xxhash64("raw"))
    rows = staged(_signed(source), "signed-texts")
    texts = staged(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("quick").alias("quick"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors")).filter(F.size("anchors") > 0).withColumn("text", F.monotonically_increasing_id()), "texts")
    weight = F.least("copies", F.lit(2))
    single = texts.select("digest", weight.alias("weight"), F.explode("anchors").alias("anchor"))
    twice = single.groupBy("anchor").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor")
    listed = single.join(twice, "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))
    wanted = texts.select("digest", "text", F.col("doc_id").alias("own"), F.col("quick").alias("own_quick"), weight.alias("weight")).join(listed, "digest")
    found = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("quick") == F.col("own_quick")))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share an id and a hash, those with the digest's text."""
        for batch in batches:
            raw, digest = batch.column("raw"), batch.column("digest")
            yield batch.filter(pa.array([xxhash.xxh3_128_digest(r.as_py()) == d.as_py() for r, d in zip(raw, digest)], pa.bool_()))

    held = found.select("digest", "text", "weight", "anchors", "raw")
    held = staged(held.mapInArrow(same, held.schema), "shared-texts")
    copied = held.filter("weight > 1").dropDuplicates(["digest"])  # rows that repeat both id and text are cut once

    # pieces of texts, then of the different pieces of anchors that have too many; no occurrence is cut twice
    first = cut = staged(_cut(held.filter("weight = 1").unionByName(copied)), "pieces")
    alone = None
    for gram in [*GRAMS[1:], None]:
        place = [F.min(c).alias(c) for c in ("text", "start")]  # of a piece that occurs once
        distinct = staged(cut.groupBy("anchor", "piece_key", "piece").agg(F.sum("weight").alias("weight"), *place), "different-pieces")
        hot = None
        if gram is not None:
            heavy = distinct.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("bytes")).filter(F.col("bytes") > ANCHOR_BYTES).select("anchor")
            heavy = staged(heavy, "heavy-anchors")
            if not heavy.isEmpty():
                hot = distinct.join(heavy, "anchor", "left_semi")
                distinct = distinct.join(heavy, "anchor", "left_anti")
        here = _alone(distinct)
        alone = here if alone is None else alone.unionByName(here)
        if hot is None:
            break
        cut = staged(_cut_again(hot, gram), "pieces")

    listed = first.filter("weight = 1").select("text", F.array(F.struct("start", (F.col("start") + F.col("strings")).alias("end"))).alias("ranges"))
    partly = held.filter("weight = 1").select("text", "digest", "raw").join(_spans(listed, alone), "text").drop("text")
    return rows.drop("anchors", "quick"), texts.select("digest", "copies"), partly


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept is null where all bytes stay."""
    rows, texts, partly = repeats(docs, id_col, text_col)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                kept, at, n = [], 0, 0
                for s in sorted(batch.column(2)[k].as_py(), key=lambda s: (s["start"], s["end"])):
                    if s["start"] > at or not n:
                        kept.append(raw[at : s["start"]])
                        n += 1
                    at = max(at, s["end"])
                whole = b"".join([*kept, raw[at:]])
                out.append((batch.column(0)[k].as_py(), len(raw) - len(whole), n, hashlib.sha256(whole).hexdigest(), whole))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    some = partly.select("digest", "raw", "spans").mapInArrow(without, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = texts.filter("copies > 1").select("digest", F.lit(True).alias("all"))
    x = rows.join(some, "digest", "left").join(whole, "digest", "left")
    none = F.lit(b"")
    return x.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("all"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("all"), F.sha2(none, 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(F.col("all"), none).otherwise(F.col("kept")).alias("kept"),
    )
