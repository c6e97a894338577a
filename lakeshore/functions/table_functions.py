"""A table function with a table argument: runs of equal values along an order. Driver-contract scope: the reference has none."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Streaks:
    """``streaks(TABLE(rows) PARTITION BY ... ORDER BY ..., value, at)``: a row for each run of rows, in the order given, that have one value in
    the column named ``value``: that value, the first and the last ``at``, and how many rows. The rows of a partition are read one by one and
    none is held, whatever a partition's size; its columns are told by the types of the table's.

    A null value is a value; rows of one partition that tie in the order come in any order, so give a full one; an empty table has no run.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, at: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not rows.dataType.names:
            raise ValueError("streaks reads a table: streaks(TABLE(rows) ..., 'value', 'at')")
        for name in (value.value, at.value):
            if name not in rows.dataType.names:
                raise ValueError(f"streaks finds no column {name} among {', '.join(rows.dataType.names)}")
        kind = rows.dataType[value.value].dataType
        when = rows.dataType[at.value].dataType
        schema = StructType().add("value", kind).add("first_at", when).add("last_at", when).add("n", LongType())
        return AnalyzeResult(schema=schema)

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row, value: str, at: str) -> Iterator[tuple]:
        own, when = row[value], row[at]
        if self.run is not None and self.run[0] == own:
            self.run[2], self.run[3] = when, self.run[3] + 1
            return
        if self.run is not None:
            yield tuple(self.run)
        self.run = [own, when, when, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield tuple(self.run)


def registered(spark: SparkSession) -> None:
    """``streaks`` as a function of the session's SQL."""
    spark.udtf.register("streaks", F.udtf(Streaks))


def streaks(rows: DataFrame, partition: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """(partition columns aside) value, first_at, last_at and n of each run; see :class:`Streaks`."""
    argument = rows.asTable().partitionBy(*partition).orderBy(*order)
    return F.udtf(Streaks)(argument, F.lit(value), F.lit(at))

