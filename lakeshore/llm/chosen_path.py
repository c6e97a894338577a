"""Near duplicates by a chosen-path set similarity join over word shingles.

Documents with equal shingle sets become one class. A sketch of a class holds the first shingle of each of BINS parts of the
hash range, so it tells a similarity to about 0.03; a pair is looked at from five deviations below the threshold on, which misses one
link in a few millions. Each of TREES independent trees deals the classes to nodes by a minwise shingle; nodes of at most LEAF
classes are compared exhaustively by sketches, larger ones branch: each class goes on by a few minwise entries of its sketch, by
hashes that the node chooses, as many as give a pair at the threshold SHARED = 1.3 ways in common on average. A pair half alike
shares about 0.8, so texts with one common passage or template part from level to level, at a power of their number
below two. However deep its nodes go, a pair at the threshold stays together in one tree with a chance of 0.5 or nearly so and misses
all trees with about 0.5 ** 12, two in ten thousand; at 0.85 alike with two in a million.

The search runs twice. The first one gathers a spanning forest of the pairs that may be linked, which are confirmed on full
shingle sets; that joins most of each group of copies without all its pairs. The second one knows the groups: it only follows
classes that the first one saw a pair of, looks only at pairs of different groups, branches only where a node holds several,
and takes the larger group of a node along only to where others go. What it finds is compared by full sets, a leaf at a time.

Nodes of at most NODE_ROWS classes are searched whole inside a task. Larger ones are cut into parts for the first search,
each with a typical class of the whole; for the second they branch as rows of a table until they are small enough, or deal their main
group over parts beside the few others.

Cases: texts without words have no shingles and no links; texts of fewer than five words have one shingle; null ids
link with nothing (component null, kept); rows that repeat an id are one node; ties don't matter; an empty table
gives an empty table; extra columns are kept by :func:`deduplicated` and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.components import components
from lakeshore.llm.shared import compact, memory, staged, unstaged

SHINGLE, THRESHOLD = 5, 75  # words; percent
TREES, SHARED, DEPTH, LEAF = 12, 1.3, 40, 64
BINS = 256
#: Classes of a node that one task searches.
NODE_ROWS = 20_000
#: Classes of whole nodes that a task looks at together, and pairs compared at once.
BATCH_ROWS, PAIRS = 20_000, 20_000
#: Classes that others of an unlabelled node are compared with before it branches.
PIVOTS = 8
#: Deviations of a sketch below which a pair isn't looked at, and above which it is taken as linked until confirmed.
BELOW, ABOVE = 5.0, 4.0
LEAST = THRESHOLD / 100
#: Bytes that differ in two of their bits, three in four of those that differ, at the threshold; as many deviations above.
MOST_DIFFERENT = BINS * 0.75 * (1 - LEAST) + BELOW * math.sqrt(BINS * 0.75 * (1 - LEAST) * (1 - 0.75 * (1 - LEAST)))
#: Similarities that part the levels of pairs below SURE.
NEAR, SURE = (0.7, 0.75, 0.8), 4
#: Pairs of a first search that are kept before they are thinned to a forest.
MOST_PAIRS = 1_000_000
#: Shingles held at once when full sets are compared.
HELD_SHINGLES = 1 << 21
_odd = np.random.default_rng(20).integers(0, 1 << 63, TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = memory("words", dict)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(ids))
    last = len(ids) - n + 1
    h = ids[:last] + np.uint64(n)
    for k in range(1, n):
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) + ids[k : k + last]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Are two shingle sets at least as similar as the threshold?"""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def sketch(own: np.ndarray) -> np.ndarray:
    """A byte of the first shingle in each of BINS parts of the hash range; 0 where a part has none."""
    out = np.zeros(BINS, np.uint8)
    part = (own >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    out[part[first]] = (own[first] & np.uint64(0xFFFFFF)) % np.uint64(255) + np.uint64(1)
    return out


SIGNED = "doc_id long, n_shingles long, digest binary, tokens array<int>, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNED for each row: digest, minwise tokens and sketch are null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, tokens, sketches = [], [], [], []
                for text in part.column(1):
                    own = shingles(text.as_py())
                    some = len(own) > 0
                    counts.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if some else None)
                    tokens.append((np.array([(own * a).min() for a in _odd], np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32) if some else None)
                    sketches.append(sketch(own).tobytes() if some else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "tokens", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


class Nodes:
    """Rows of whole nodes and the pairs among them that may be linked, found by descending chosen paths."""

    def __init__(self, table: pa.Table, labelled: bool, leaf: int) -> None:
        rep, node = (table[c].to_numpy() for c in ("rep", "node"))
        order = np.lexsort((_mixed(rep), node))  # by a hash: the same class is the pivot of most nodes it is in
        self.rep, self.node = rep[order], node[order]
        self.size, self.label = (table[c].to_numpy()[order] for c in ("size", "label"))
        self.label = self.label.copy()
        self.sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[order]
        #: Two bits of each byte, packed: what differs in them differs.
        self.bits = [np.packbits(self.sketch >> k & 1, axis=1).view(np.uint64) for k in (0, 1)]
        self.labelled, self.leaf = labelled, leaf
        self.leaves: list[np.ndarray] = []
        #: (rows a, rows b, level) of a first search's pairs; of a labelled one the (held, others) groups they were found in.
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_pairs = self.n_kept = 0
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []

    def search(self) -> Iterator[None]:
        """Fill ``pairs`` and ``groups``; stops whenever some nodes are done, so that groups can be taken out."""
        cuts = np.flatnonzero(np.diff(self.node)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.append(cuts, len(self.node))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            if b - a <= self.leaf:
                self.leaves.append(np.arange(a, b))
            else:
                self._descend(np.arange(a, b), 0, int(self.node[a]), 1.0)
            if len(self.leaves) > 5000:
                self._compare_leaves()
            yield
        self._compare_leaves()
        yield

    def _may_link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows: may they be linked, and how near do they look (SURE: as good as linked)?"""
        may = (100 * np.minimum(self.size[a], self.size[b]) >= THRESHOLD * np.maximum(self.size[a], self.size[b])) & (self.rep[a] != self.rep[b])
        level = np.zeros(len(may), np.int8)
        differ = np.bitwise_count((self.bits[0][a] ^ self.bits[0][b]) | (self.bits[1][a] ^ self.bits[1][b])).sum(axis=1)
        at = np.flatnonzero(may & (differ <= MOST_DIFFERENT))
        may[:] = False
        for k in range(0, len(at), PAIRS):
            own = at[k : k + PAIRS]
            x, y = self.sketch[a[own]], self.sketch[b[own]]
            used = np.count_nonzero(x | y, axis=1)
            same = np.count_nonzero((x == y) & (x != 0), axis=1)
            # the used parts draw that many of both texts' different shingles, of which so many there are at the threshold
            both = np.maximum(used, (self.size[a[own]] + self.size[b[own]]) / (1 + LEAST))
            mean, deviation = used * LEAST, np.sqrt(used * LEAST * (1 - LEAST) * (1 - used / (both + 1)))
            may[own] = same >= mean - BELOW * deviation - 1
            level[own] = np.where(same >= np.minimum(used, mean + ABOVE * deviation), SURE, np.searchsorted(NEAR, same / np.maximum(used, 1)))
        return may, level

    def _descend(self, rows: np.ndarray, depth: int, seed: int, load: float) -> None:
        """Compare the rows of a large node, or branch."""
        if not self.labelled:
            self._absorb(rows)
        labels, of, many = np.unique(self.label[rows], return_inverse=True, return_counts=True)
        apart = of != many.argmax()
        rest = rows[apart]
        if not len(rest):
            return
        if len(rest) <= self.leaf or depth >= DEPTH:
            self._compare_block(rest, rows)
            return
        children: list[tuple[np.ndarray, int]] = []
        for k, (own, token) in enumerate(_ways(self.sketch[rows], self.size[rows], seed)):
            goes = np.isin(token, token[apart[own]])  # the main group goes along only to where others go
            own, token = own[goes], token[goes]
            by = np.argsort(token, kind="stable")
            for child in np.split(by, np.flatnonzero(np.diff(token[by])) + 1):
                below = rows[own[child]]
                if len(below) > 1 and (self.label[below] != self.label[below[0]]).any():
                    children.append((below, _child(seed, k, int(token[child[0]]))))
        load *= sum(len(below) ** 2 for below, _ in children) / (len(rest) * len(rows))
        if load > 2:
            self._compare_block(rest, rows)  # pairs multiply on the way down instead of parting
            return
        for below, name in children:
            if len(below) <= self.leaf:
                self.leaves.append(below)
            else:
                self._descend(below, depth + 1, name, load)
            if len(self.leaves) > 5000:
                self._compare_leaves()

    def _absorb(self, rows: np.ndarray) -> None:
        """Compare all rows with a few pivots; what looks as good as linked with one takes its label.

        A pivot is the row nearest to what most rows have in each part of the sketch: of copies with changes of their own, the original.
        """
        free = np.ones(len(rows), bool)
        for _ in range(PIVOTS):
            if not free.any():
                break
            pivot = rows[free][typical(self.sketch[rows[free]])]
            may, level = self._may_link(np.full(len(rows), pivot), rows)
            self._found(np.full(int(may.sum()), pivot), rows[may], level[may])
            sure = may & (level == SURE)
            self._join(rows, pivot, rows[sure])
            free &= ~sure
            free[rows == pivot] = False

    def _join(self, rows: np.ndarray, x: int, partners: np.ndarray) -> None:
        """The partners' labels become that of ``x``, in ``rows``."""
        self.label[rows[np.isin(self.label[rows], self.label[partners])]] = self.label[x]

    def _found(self, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> None:
        self.n_pairs += len(a)
        if self.labelled or not len(a):
            return
        self.pairs.append((a, b, level))
        self.n_kept += len(a)
        if self.n_kept > MOST_PAIRS:
            self._thin()

    def _compare_block(self, rest: np.ndarray, rows: np.ndarray) -> None:
        held, partners = [], []
        free = np.ones(len(rows), bool)
        place = np.argsort(rows)[np.searchsorted(np.sort(rows), rest)]
        for x, k in zip(rest.tolist(), place.tolist()):
            free[k] = False
            others = rows[free & (self.label[rows] != self.label[x])]
            may, level = self._may_link(np.full(len(others), x), others)
            if may.any():
                self._found(np.full(int(may.sum()), x), others[may], level[may])
                if self.labelled:
                    held.append(x)
                    partners.append(others[may])
                else:
                    self._join(rows, x, others[may])
        for at in range(0, len(held), self.leaf):
            self.groups.append((np.array(held[at : at + self.leaf]), np.unique(np.concatenate(partners[at : at + self.leaf]))))

    def _compare_leaves(self) -> None:
        if not self.leaves:
            return
        row, leaf = np.concatenate(self.leaves), np.repeat(np.arange(len(self.leaves)), list(map(len, self.leaves)))
        self.leaves = []
        found = []
        for step in range(1, len(row)):
            at = np.flatnonzero(leaf[step:] == leaf[:-step])
            if not len(at):
                break
            at = at[self.label[row[at]] != self.label[row[at + step]]]
            for k in range(0, len(at), PAIRS):
                x = at[k : k + PAIRS]
                may, level = self._may_link(row[x], row[x + step])
                x = x[may]
                self._found(row[x], row[x + step], level[may])
                if self.labelled and len(x):
                    found.append((x, x + step))
        if found:  # pairs, the same ones in most trees; where there are many, all that they connect in a leaf
            a, b = (np.concatenate(x) for x in zip(*found))
            root = spanning(a, b, len(row))[1]
            own = np.unique(np.concatenate((a, b)))
            own = own[np.argsort(root[own], kind="stable")]
            dense = np.bincount(root[a], minlength=len(row)) > 2 * np.bincount(root[own], minlength=len(row))
            for held in np.split(own, np.flatnonzero(np.diff(root[own])) + 1):
                if dense[root[held[0]]]:
                    self.groups.append((row[held], row[:0]))
            some = ~dense[root[a]]
            self.groups += [(pair, row[:0]) for pair in np.stack((row[a[some]], row[b[some]]), axis=1)]

    def _thin(self) -> None:
        """Keep as few pairs, nearest first, as connect the classes that all of them connect."""
        a, b, level = (np.concatenate(x) for x in zip(*self.pairs))
        reps, of = np.unique(self.rep, return_inverse=True)
        rank = np.argsort(np.argsort(_mixed(reps)))
        u, v, root, chosen = rank[of[a]], rank[of[b]], np.arange(len(reps)), []
        for k in range(SURE, -1, -1):
            at = np.flatnonzero(level == k)
            kept, further = spanning(root[u[at]], root[v[at]], len(reps))
            root = further[root]
            chosen.append(at[kept])
        some = np.concatenate(chosen)
        self.pairs, self.n_kept = [(a[some], b[some], level[some])], len(some)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the pairs that are left of a first search."""
        if not self.pairs:
            return self.rep[:0], self.rep[:0]
        self._thin()
        a, b, _ = self.pairs[0]
        return self.rep[a], self.rep[b]


def typical(sketches: np.ndarray) -> int:
    """The row that has most often what most rows have in a part."""
    many = np.bincount((np.arange(BINS) * 256 + sketches).ravel(), minlength=BINS * 256).reshape(BINS, 256)
    return int((sketches == many.argmax(axis=1)).sum(axis=1).argmax())


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_entries = np.random.default_rng(21).integers(0, 1 << 63, (BINS, 256), dtype=np.uint64)
_entries[:, 0] = 0


def _ways(sketches: np.ndarray, sizes: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their tokens) of each way that a node branches: the least of a class's sketch entries by a hash of the node's."""
    # entries that two sets of this size, as alike as the threshold, share of all entries of both
    used, both = (1 - np.exp(-sizes * k / BINS) for k in (1.0, 2 / (1 + LEAST)))
    ways = SHARED * (2 * used - LEAST * both) / (LEAST * both)
    part = _child(seed, -1, 0) % 4096 / 4096
    for k in range(1 + int(ways.max() + part)):
        own = np.flatnonzero(k + part < ways)
        if not len(own):
            return
        hashed = _entries * np.uint64(_child(seed, k, 0) | 1) >> np.uint64(32)
        hashed[:, 0] = 1 << 32
        yield own, hashed[np.arange(BINS), sketches[own]].min(axis=1)


def _child(seed: int, way: int, token: int) -> int:
    """The name of the node behind a token, an unsigned number of 64 bits."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{way}|{token}")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of pairs that make a spanning forest, the smallest node that each of ``n`` nodes is connected with).

    Each round every node hooks on to its smallest smaller neighbour, and pairs are rewritten to where their ends hang."""
    root, kept = np.arange(n), []
    lo, hi, place = np.minimum(u, v), np.maximum(u, v), np.arange(len(u))
    while True:
        some = lo != hi
        lo, hi, place = lo[some], hi[some], place[some]
        if not len(place):
            return np.concatenate(kept) if kept else place, root
        by = np.lexsort((lo, hi))
        first = by[np.flatnonzero(np.diff(hi[by], prepend=-1))]
        kept.append(place[first])
        hook = np.arange(n)
        hook[hi[first]] = lo[first]
        while (further := hook[hook] != hook).any():
            hook = hook[hook]
        root = hook[root]
        lo, hi = np.minimum(hook[lo], hook[hi]), np.maximum(hook[lo], hook[hi])


NODE_COLUMNS = ["node", "rep", "size", "label", "sketch"]


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes, from batches sorted by node."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH_ROWS:
            continue
        t = pa.Table.from_batches(held)
        node = t["node"].to_numpy()
        cut = int(np.searchsorted(node, node[-1]))  # the last node may go on
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), len(node) - cut
    if held:
        yield pa.Table.from_batches(held)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE_COLUMNS).repartition("node").sortWithinPartitions("node")


def forest_within(nodes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of what may be linked inside nodes (NODE_COLUMNS, labels all different)."""
    leaf = LEAF

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_nodes(batches):
            x = Nodes(t, False, leaf)
            for _ in x.search():
                pass
            a, b = x.forest()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _dealt(nodes).mapInArrow(search, "a long, b long")


GROUPS = "grp long, turn int, rep long, label long"


def groups_within(nodes: DataFrame) -> DataFrame:
    """GROUPS: inside nodes (NODE_COLUMNS), classes (turn 0) to be compared with each other and with those of turn 1, as each
    may be linked with one of another label. The same group has the same ``grp`` wherever it is found."""
    leaf, most = LEAF, HELD_SHINGLES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_nodes(batches):
            x = Nodes(t, True, leaf)
            for _ in x.search():
                taken, x.groups = x.groups, []
                if taken:
                    yield group_rows(x, taken)

    def group_rows(x: Nodes, groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, turns, rows = [], [], []
        for held, others in groups:
            cut = np.cumsum(x.size[held]) // most
            for k in np.unique(cut).tolist():  # very long texts: fewer at a time, against all that follow
                own, later = held[cut == k], np.setdiff1d(np.concatenate((held[cut > k], others)), held[cut == k])
                name = xxhash.xxh3_64_intdigest(np.sort(x.rep[own]).tobytes() + b"|" + np.sort(x.rep[later]).tobytes()) - (1 << 63)
                rows += [own, later]
                turns.append(np.repeat(np.array([0, 1], np.int32), [len(own), len(later)]))
                names.append(np.full(len(own) + len(later), name))
        at = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(turns)), pa.array(x.rep[at]), pa.array(x.label[at])], names=["grp", "turn", "rep", "label"])

    return _dealt(nodes).mapInArrow(search, GROUPS).dropDuplicates(["grp", "rep"])


def branched(nodes: DataFrame) -> DataFrame:
    """The children of large nodes (NODE_COLUMNS), as rows."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sketches = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BINS)
            for seed in np.unique(node).tolist():
                rows = np.flatnonzero(node == seed)
                for k, (own, token) in enumerate(_ways(sketches[rows], size[rows], seed)):
                    names = {t: _child(seed, k, t) - (1 << 63) for t in np.unique(token).tolist()}
                    below = batch.take(pa.array(rows[own]))
                    yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in token.tolist()], pa.int64()), *below.columns[1:]], names=NODE_COLUMNS)

    return nodes.select(*NODE_COLUMNS).mapInArrow(branch, "node long, rep long, size long, label long, sketch binary")


def _parts(n: str, rows: int):
    return F.ceil(F.col(n) / rows).cast("int")


def _part_node(*of) -> F.Column:
    return F.xxhash64("node", *of)


def in_parts(hot: DataFrame) -> DataFrame:
    """Nodes of over NODE_ROWS classes as nodes of about NODE_ROWS: by a hash, each with the most typical class of all parts."""
    parts = hot.withColumn("part", F.pmod(F.xxhash64("rep"), _parts("n", NODE_ROWS)).cast("int")).withColumn("whole", F.col("node")).withColumn("node", _part_node("part"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_nodes(batches):
            node = t["node"].to_numpy()
            sketches = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
            for rows in np.split(np.arange(len(node)), np.flatnonzero(np.diff(node)) + 1):
                own = sketches[rows]
                best = typical(own)
                score = int((own == own[best]).sum()) // len(own)  # of one whole node's parts, which are alike
                for batch in t.slice(int(rows[best]), 1).to_batches():
                    yield batch.append_column("score", pa.array([score], pa.int64()))

    columns = [*NODE_COLUMNS, "whole", "n"]
    dealt = parts.select(*columns).repartition("node").sortWithinPartitions("node")
    chosen = dealt.mapInArrow(choose, "node long, rep long, size long, label long, sketch binary, whole long, n long, score long")
    best = chosen.groupBy("whole").agg(F.max("n").alias("n"), F.max(F.struct("score", "rep", "size", "label", "sketch")).alias("best"))
    each = best.select(F.col("whole").alias("node"), "best.rep", "best.size", "best.label", "best.sketch", F.explode(F.sequence(F.lit(0), _parts("n", NODE_ROWS) - 1)).alias("part"))
    return parts.select(*NODE_COLUMNS).unionByName(each.withColumn("node", _part_node("part")).select(*NODE_COLUMNS)).distinct()


def narrowed(hot: DataFrame) -> DataFrame:
    """Labelled nodes of over NODE_ROWS classes as smaller ones, which hold each pair of different labels that the paths keep.

    A node with few classes outside its main group deals that group over parts, each beside all the others; else it branches.
    What is as large after DEPTH levels, or multiplies, is compared part by part.
    """
    done: list[DataFrame] = []
    most = 0
    rows = hot.select(*NODE_COLUMNS)
    for level in range(DEPTH + 1):
        main = F.min(F.struct(F.xxhash64("rep").alias("h"), "label"))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), main.alias("main"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("n > 1 and lo != hi")
        x = rows.join(nodes.select("node", "n", F.col("main.label").alias("main")).hint("merge"), "node")
        others = x.groupBy("node").agg(F.count_if(F.col("label") != F.col("main")).alias("n_rest"))
        x = staged(x.join(others.hint("merge"), "node"), "large-nodes")
        small = F.col("n") <= NODE_ROWS
        few = ~small & (F.col("n_rest") <= NODE_ROWS // 4)
        k = _parts("n", max(1, NODE_ROWS // 2))
        own = F.pmod(F.xxhash64("rep"), k).cast("int")
        every = F.sequence(F.lit(0), k - 1)
        parts = x.filter(few).withColumn("part", F.explode(F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(every)))
        done += [x.filter(small).select(*NODE_COLUMNS), parts.withColumn("node", _part_node("part")).select(*NODE_COLUMNS)]
        far = x.filter(~small & ~few)
        many = far.count()
        most = most or 4 * many
        if not many:
            break
        if level == DEPTH or many > most:
            both = far.withColumn("own", own).withColumn("part", F.explode(every))
            done.append(both.withColumn("node", _part_node(F.least("own", "part"), F.greatest("own", "part"))).select(*NODE_COLUMNS))
            break
        rows = branched(far)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked; ``texts`` has (rep, text)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                if text != last[0]:
                    last = (text, shingles(text))
                if linked(shingles(batch.column(3)[k].as_py()), last[1]):
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    side = lambda end: texts.select(F.col("rep").alias(end), F.col("text").alias(f"text_{end}")).hint("merge")
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirm, "a long, b long")


class _Held:
    """Shingle sets of a group's held classes, to be compared with one set at a time."""

    def __init__(self, rows: list[tuple[int, int, str]]) -> None:
        self.rep, self.label = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.sets = [shingles(r[2]) for r in rows]
        self.size = np.array(list(map(len, self.sets)))
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
        by = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[by], owner[by]

    def links(self, own: np.ndarray, label: int) -> np.ndarray:
        """Places of the held classes with another label that are linked with the set ``own``."""
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many)
        at += np.arange(len(at))
        common = np.bincount(self.owner[at], minlength=len(self.size))
        return np.flatnonzero((100 * common >= THRESHOLD * (self.size + len(own) - common)) & (self.label != label))


def linked_in_groups(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between labels, by full shingle sets, that connect what all links inside the GROUPS connect."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held, root = None, [], None, {}
        a: list[int] = []
        b: list[int] = []

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        def look(label: int, own: np.ndarray) -> None:
            for k in held.links(own, label).tolist():
                x, y = find(label), find(int(held.label[k]))
                if x != y:  # labels are groups that are known to be connected
                    root[max(x, y)] = min(x, y)
                    a.append(label)
                    b.append(int(held.label[k]))

        def hold() -> _Held:
            nonlocal held
            held = _Held(waiting)
            for label, own in zip(held.label.tolist(), held.sets):
                look(label, own)
            return held

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):
                grp, turn, rep, label, text = (batch.column(c)[k].as_py() for c in range(5))
                if grp != now:
                    if waiting and held is None:
                        hold()
                    now, waiting, held, root = grp, [], None, {}
                if turn == 0:
                    waiting.append((rep, label, text))
                    continue
                if held is None:
                    hold()
                look(label, shingles(text))
            yield out()
        if waiting and held is None:
            hold()
        yield out()

    own = groups.join(texts.hint("merge"), "rep").select("grp", "turn", "rep", "label", "text")
    return own.repartition("grp").sortWithinPartitions("grp", "turn", "rep").mapInArrow(compare, "a long, b long")


def linked_classes(classes: DataFrame, texts_of: DataFrame) -> DataFrame:
    """(node, label) of all classes (rep, size, tokens, sketch) that have links; ``texts_of`` has (doc_id, text)."""
    tree_rows = classes.select("rep", F.posexplode("tokens").alias("tree", "token")).select("rep", F.xxhash64("tree", "token").alias("node"))
    shared = tree_rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    rows = tree_rows.join(shared.hint("merge"), "node")
    rows = staged(rows.join(classes.select("rep", "size", "sketch").hint("merge"), "rep").withColumn("label", F.col("rep")), "tree-rows")
    small, hot = rows.filter(F.col("n") <= NODE_ROWS), rows.filter(F.col("n") > NODE_ROWS)
    any_hot = not hot.isEmpty()

    # the first search: a forest of what may be linked, confirmed on full sets
    first = small.select(*NODE_COLUMNS)
    edges = staged(forest_within(first.unionByName(in_parts(hot)) if any_hot else first).distinct(), "edges")
    ends = edges.select(F.col("a").alias("rep")).union(edges.select(F.col("b").alias("rep"))).distinct()
    names = ends.union(hot.select("rep")).distinct() if any_hot else ends
    texts = staged(texts_of.select(F.col("doc_id").alias("rep"), "text").join(names.hint("merge"), "rep", "left_semi"), "texts")
    labels = components(confirmed(edges, texts))

    # the second search: what is left between groups
    known = labels.select(F.col("node").alias("rep"), F.col("label").alias("known")).hint("merge")
    labelled = lambda x: x.join(known, "rep", "left").withColumn("label", F.coalesce("known", "rep")).select(*NODE_COLUMNS)
    again = labelled(small.join(ends.hint("merge"), "rep", "left_semi"))
    if any_hot:
        again = again.unionByName(narrowed(labelled(hot)))
    groups = staged(groups_within(again), "groups")
    late = staged(linked_in_groups(groups, texts), "late")
    for done in (rows, edges, texts, groups):
        unstaged(done)
    if late.isEmpty():
        return labels
    joined = components(late)  # of labels
    ends = labels.unionByName(joined.select("node", F.col("node").alias("label")).join(labels.select("node").hint("merge"), "node", "left_anti"))
    return ends.join(joined.select(F.col("node").alias("label"), F.col("label").alias("final")).hint("merge"), "label", "left").select("node", F.coalesce("final", "label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    signed = staged(signatures(docs), "signatures")
    of = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = staged(of, "classes")
    labels = linked_classes(classes, docs)
    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component (that of the smallest id; equal rows of it are one)."""
    keep = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    one = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.filter("doc_id is null"))
