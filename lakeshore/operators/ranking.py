"""The first rows of each group. Driver-contract scope: the reference keeps the newest of all records only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, ties: bool = False, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, numbered from 1 in ``rank``; with ``ties`` also those that tie with the last of them,
    all under their common rank.

    Spark limits each group before the shuffle, so a task passes on ``k`` rows of a hot group (and what ties with the last), whatever its
    size. Without ``ties`` give a full order: else which of equal rows stays is left open. A null key is a group; an empty table has none.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    place = F.rank() if ties else F.row_number()
    return rows.withColumn(rank, place.over(over)).filter(F.col(rank) <= k)
