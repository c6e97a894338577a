"""Whitening of embedding vectors: components of their covariance, from counts, means and centred scatters merged pairwise.

Entries become integers on a grid of 1/64, so that sums are exact, and each different vector is fitted once. A partition computes its
count, mean and the scatter about its own mean; two of those merge by Chan's formula, which adds the scatter of the two means, so nothing
is ever subtracted that is large beside the result. The merges run as a tree on the executors; the driver gets one matrix and
decomposes it. A second pass over the fitted vectors merges the moments of the whitened ones in the same way and holds their covariance
against the identity.

Cases: null vectors and those with null, infinite or NaN entries are left out; vectors of different lengths are spaces of their own,
each with its own fit; a vector without entries has no component; components without variance (an eigenvalue within rounding of zero) have
null whitened values and count nothing in the identity error, and where all vectors are one, explained is null too; entries beyond
LARGEST are held at it; a deviation that a long can't hold is null; repeated rows are fitted once and each keeps its result; an empty
table gives an empty one; other columns stay, those of added names as name_own. A task's memory grows with the square of a vector's
length, not with rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import set_aside, staged, unstaged, widened

#: Steps of the grid to a unit, what is added to a step's number, and components returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest entry (by absolute value) that is told from larger ones: steps stay exact as doubles.
LARGEST = float(1 << 46)
#: Share of the largest eigenvalue up to which another one counts as no variance: rounding makes as much.
TINY = 1e-11
#: Merges of one level of the tree go to about the root of this depth of all partitions.
DEPTH = 2
#: Whitened rows to a batch of results.
BATCH_ROWS = 4096


def on_grid(vector: Column) -> Column:
    """The entries' numbers on the grid; null if the vector or an entry is null, or an entry is no finite number."""
    as_double = lambda c: c.cast("double")
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(as_double(c)) & (F.abs(as_double(c)) < F.lit(float("inf"))), F.lit(False)))
    held = lambda c: F.greatest(F.least(as_double(c), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(usable, F.transform(vector, lambda c: F.floor(held(c) * STEPS) + F.lit(SHIFT).cast("long")))


@dataclass
class Moments:
    """Of vectors of one length: how many, their sums (exact where they are integers), mean, and the scatter about it."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of integers, as Python's integers."""
    most = float(np.abs(x).max()) * len(x)
    return x.sum(axis=0).astype(object) if most < 2.0**62 else x.astype(object).sum(axis=0)


def moments(x: np.ndarray) -> Moments:
    """Of the rows of ``x``: taken about its first row, then about their mean, then corrected for what rounding left of it."""
    off = (x - x[0]).astype(float)
    step = off.mean(axis=0)
    off -= step
    lost = off.sum(axis=0)
    scatter = off.T @ off - np.outer(lost, lost) / len(x)
    sums = exact_sums(x) if x.dtype == np.int64 else x.sum(axis=0)
    return Moments(len(x), sums, x[0] + (step + lost / len(x)), scatter)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula for two disjoint sets."""
    n = a.n + b.n
    apart = b.mean - a.mean
    if a.sums.dtype == object:  # integers: exact before it is rounded, however large the means are beside it
        apart = np.array([float(Fraction(q * a.n - p * b.n, a.n * b.n)) for p, q in zip(a.sums, b.sums)])
    return Moments(n, a.sums + b.sums, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


#: Moments by the length of vectors.
Spaces = dict[int, Moments]


def merged_spaces(a: Spaces, b: Spaces) -> Spaces:
    return {d: merged(a[d], b[d]) if d in a and d in b else (a.get(d) or b[d]) for d in sorted(a.keys() | b.keys())}


class Space:
    """The fit of one length: its components, by falling eigenvalue, the largest entry of each positive."""

    def __init__(self, found: Moments, components: int) -> None:
        self.n, self.sums = found.n, found.sums
        values, vectors = np.linalg.eigh((found.scatter + found.scatter.T) / (2 * found.n))
        values, vectors = np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components]
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        total = float(np.trace(found.scatter)) / found.n
        self.explained = values / total if total > 0 else np.full(len(values), np.nan)
        self.live = int((values > values[0] * TINY).sum())
        self.scale = self.vectors[:, : self.live] / np.sqrt(values[: self.live])
        # the mean as a whole number and a rest, both exact
        self.low = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = self.sums - self.low.astype(object) * self.n
        self.fraction = np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the rows of ``x``, for the components that have variance."""
        return ((x - self.low) - self.fraction) @ self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sums) squared, None where it is no long."""
        off = x - self.low
        most = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            apart = off * self.n - self.rest.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = ((off.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


@dataclass
class Model:
    """The fit of each length, and the largest entry by which the covariance of whitened vectors is off the identity."""

    spaces: dict[int, Space]
    identity_error: float | None = None


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows as a matrix) for each length among a batch's vectors, of which none is null."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    for d in np.unique(np.diff(offsets)):
        rows = np.flatnonzero(np.diff(offsets) == d)
        if d:
            yield rows, values[offsets[rows][:, None] + np.arange(d)]


def gathered(vectors: DataFrame, model: Model | None = None) -> Spaces:
    """Moments by length of the vectors in the only column of ``vectors``, or of their whitened values by ``model``: a partition's
    batches one after the other, then partitions in a tree."""
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Spaces = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                y = x if shared.value is None else shared.value.spaces[x.shape[1]].project(x)
                if y.shape[1]:
                    found = merged_spaces(found, {x.shape[1]: moments(y)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)])], names=["found"])

    partitions = vectors.mapInArrow(partial, "found binary").rdd.map(lambda row: pickle.loads(bytes(row.found)))
    return context.parallelize([{}], 1).union(partitions).treeReduce(merged_spaces, DEPTH)


def fitted(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model:
    """The fit of all different vectors of ``rows``, with its identity error from a second pass over them."""
    different = rows.select(on_grid(F.col(vector_col)).alias("x")).filter("x is not null").distinct()
    kept = staged(different, "whitening-vectors")
    model = Model({d: Space(found, components) for d, found in gathered(kept).items()})
    whitened = gathered(kept, model)
    model.identity_error = max((float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max()) for m in whitened.values()), default=None)
    unstaged(kept)
    return model


def whitened(rows: DataFrame, model: Model, vector_col: str = "embedding") -> DataFrame:
    """Rows with a usable vector, with deviation, n (vectors fitted) and components: an array of (component, whitened, explained)."""
    rows = set_aside(rows, "n", "deviation", "components", "grid")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = shared.value.spaces
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(at, BATCH_ROWS).columns], names=whole.schema.names)
                found = [(r, x, spaces[x.shape[1]]) for r, x in matrices(batch.column(len(names)))]
                size, n, deviation = np.zeros(batch.num_rows, np.int64), [0] * batch.num_rows, [0] * batch.num_rows
                for r, _, space in found:
                    size[r] = len(space.explained)
                ends = np.concatenate(([0], np.cumsum(size)))
                number, value, explained = np.zeros(ends[-1], np.int32), np.full(ends[-1], np.nan), np.zeros(ends[-1])
                for r, x, space in found:
                    k = len(space.explained)
                    place = ends[r][:, None] + np.arange(k)
                    number[place], explained[place] = np.arange(1, k + 1), space.explained
                    value[place[:, : space.live]] = space.project(x)
                    for i, v in zip(r.tolist(), space.deviations(x)):
                        n[i], deviation[i] = space.n, v
                fields = [pa.array(number), pa.array(value, mask=np.isnan(value)), pa.array(explained, mask=np.isnan(explained))]
                each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["component", "whitened", "explained"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(deviation, pa.int64()), each], names=[*names, "n", "deviation", "components"])

    usable = rows.withColumn("grid", on_grid(F.col(vector_col))).filter("grid is not null")
    return usable.mapInArrow(project, widened(rows, "n long, deviation long, components array<struct<component:int,whitened:double,explained:double>>"))
