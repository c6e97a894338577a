"""Distinct counts and quantiles from sketches that are stored by group and merged later. Driver-contract scope: the reference has neither.

A sketch is a few kilobytes whatever it has seen, and merging the sketches of parts gives one of the whole, so a year's distinct
users come from stored days without reading the events again; a hot group is sketched in its parts before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes: registers of a distinct count (as a power of two) and items of a level of a quantile sketch.
LOG_REGISTERS, LEVEL_ITEMS = 12, 400
#: Bounds on errors. Of a distinct count, as a share of it: three times the standard error of so many registers; of a quantile's rank, as a
#: share of the rows: twice what a sketch of such levels leaves in 99 of 100 cases.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2), 2 * 2.296 / LEVEL_ITEMS**0.9021


def sketched(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, distinct_sketch, value_sketch) of each group, to be stored. Nulls of either column aren't counted; a group with none but
    nulls has a sketch of nothing; an empty table has no group."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), LEVEL_ITEMS).alias("value_sketch"),
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sketches of finer groups as those of the groups ``keys``."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def estimated(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``sketches`` with n_distinct, and quantile_0, quantile_1 ... as asked for; null where a group has no value."""
    has = F.kll_sketch_get_n_double("value_sketch") > 0
    of = lambda q: F.when(has, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(q))))
    return sketches.withColumns({"n_distinct": F.hll_sketch_estimate("distinct_sketch"), **{f"quantile_{k}": of(q) for k, q in enumerate(quantiles)}})
