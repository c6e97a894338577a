"""Joins of intervals that overlap, and sums over the time just before each row. Driver-contract scope: the reference has neither.

Nothing here compares all rows with all rows: intervals meet in bins as wide as the longer one of two, so long ones don't
multiply short ones beyond two bins for each length class, and time frames are cut into buckets that bring along the rows just before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _place(df: DataFrame, name: str) -> Column:
    """A position as a whole number: times in microseconds, whole numbers as they are."""
    kind = df.schema[name].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("long")
    raise TypeError(f"{name} is a {kind}: intervals have whole numbers or times as ends")


def _levels(df: DataFrame) -> list[int]:
    """Length classes that occur: 64 at most."""
    return sorted(r[0] for r in df.select("_own").distinct().collect())


def _dealt(df: DataFrame, others: list[int]) -> DataFrame:
    """A row for each bin (_level, _bin) of an interval's own class, and of each longer class that the other side has."""
    longer = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_own"))
    x = df.withColumn("_level", F.explode(F.concat(F.array("_own"), longer)))
    return x.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_from, _level), shiftright(_to, _level))")))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str] = (), start: str = "start", end: str = "end", prefix: str = "other_") -> DataFrame:
    """Each pair of rows, equal in ``on``, whose intervals [start, end] share a point; columns of ``right`` get ``prefix``.

    An interval's class is the power of two above its length, so it lies in at most two bins of that width. Two intervals meet at the
    larger of their classes, in the bin where the later one of them starts: in one bin only. Intervals without an end or a start, those that
    end before they start, and nulls in ``on`` meet nothing; points (start = end) meet what holds them; equal rows meet as often as
    they occur; an empty side gives no pair.
    """

    def classed(df: DataFrame) -> DataFrame:
        x = df.withColumns({"_from": _place(df, start), "_to": _place(df, end)}).filter("_from <= _to")
        size = F.col("_to") - F.col("_from")
        return x.withColumn("_own", F.when(size == 0, F.lit(0)).otherwise(F.length(F.bin(size))))

    a, b = classed(left), classed(right)
    of_a, of_b = _levels(a), _levels(b)
    first, second = _dealt(a, of_b), _dealt(b, of_a)
    second = second.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns], *[F.col(c).alias(f"_other{c}") for c in ("_from", "_to", "_own", "_level", "_bin")])
    met = (F.col("_level") == F.col("_other_level")) & (F.col("_bin") == F.col("_other_bin"))
    for c in on:
        met &= F.col(c) == F.col(f"{prefix}{c}")
    met &= (F.col("_level") == F.greatest("_own", "_other_own")) & (F.col("_from") <= F.col("_other_to")) & (F.col("_other_from") <= F.col("_to"))
    met &= F.col("_bin") == F.expr("shiftright(greatest(_from, _other_from), _level)")
    return first.join(second, met).select(*left.columns, *[f"{prefix}{c}" for c in right.columns])


def within(rows: DataFrame, key: str, at: str, seconds: int, aggregates: dict[str, Column], bucket_s: int | None = None) -> DataFrame:
    """``rows`` with ``aggregates`` over the rows of the same key at their time or up to ``seconds`` before, themselves included.

    A key's rows are dealt to buckets of ``bucket_s`` seconds (at least ``seconds``; that by default), each with the rows of the bucket
    before that its frames reach, so a hot key is spread over its buckets. Rows of one time see each other; rows without
    a time see only one another; a null key is a key.
    """
    width = max(seconds, bucket_s or seconds) * 1_000_000
    reach = seconds * 1_000_000
    x = rows.withColumn("_at", _place(rows, at)).withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
    ahead = (F.col("_at") + reach) >= (F.col("_bucket") + 1) * width
    copies = F.when(ahead, F.array(F.struct(F.lit(0).alias("b"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.lit(0).alias("b"), F.lit(True).alias("own"))))
    x = x.withColumn("_copy", F.explode(copies)).withColumn("_in", F.col("_bucket") + F.col("_copy.b"))
    frame = Window.partitionBy(key, "_in").orderBy("_at").rangeBetween(-reach, 0)
    return x.withColumns({name: a.over(frame) for name, a in aggregates.items()}).filter("_copy.own").select(*rows.columns, *aggregates)
