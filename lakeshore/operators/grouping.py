"""Totals over several groupings at once, and set operations that count copies. Driver-contract scope: the reference has neither."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a measure is taken of rows, and how such measures of parts become one of the whole.
MERGED = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def rolled_up(keys: Sequence[str]) -> list[list[str]]:
    """Groupings by all keys, by all but the last, and so on to the grand total."""
    return [list(keys[:k]) for k in range(len(keys), -1, -1)]


def cubed(keys: Sequence[str]) -> list[list[str]]:
    """Groupings by each choice of keys."""
    return [list(c) for k in range(len(keys), -1, -1) for c in combinations(keys, k)]


def totals(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], measures: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """(keys, all_<key> for each key, measures) of each grouping in ``sets``; ``measures``: name to (sum, count, min or max; column).

    Rows are measured by all keys first, which combines hot groups before any shuffle; only those few results are expanded to the
    groupings. Where a key is summed over it is null and all_<key> true; a null key of the data is a group of its own with all_<key>
    false. A grouping listed twice comes twice; an empty table has no group, not even a grand total.
    """
    fine = rows.groupBy(*keys).agg(*[MERGED[how][0](column).alias(name) for name, (how, column) in measures.items()])
    out = fine.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    flags = [(F.grouping(k) == 1).alias(f"all_{k}") for k in keys]
    return out.agg(*flags, *[MERGED[how][1](name).alias(name) for name, (how, _) in measures.items()])


def multiset(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of ``left`` that ``right`` has too (``both``), as often as both have them, or beyond what it has (``beyond``), as often as
    that is. Columns are matched by name; nulls equal nulls; copies are counted before the shuffle, so many are no hot task."""
    other = right.select(*left.columns)
    if how == "both":
        return left.intersectAll(other)
    if how == "beyond":
        return left.exceptAll(other)
    raise ValueError(f"how is both or beyond, not {how}")
