"""Tables of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The sections in order.
SECTIONS = ["meet-us", "cover-design", "layout-design", "illustrations", "galore", "corporate-design", "reach-us"]


def ordered(spark: SparkSession, ids: list[str] | None = None) -> DataFrame:
    """(idx, id, label): ids in order, labels from the ids' words."""
    ids = SECTIONS if ids is None else ids
    return spark.createDataFrame([(k, i, i.replace("-", " ").title()) for k, i in enumerate(ids)], "idx int, id string, label string")
