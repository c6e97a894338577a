"""Lookups along an order: the last band at or below a position, carried values, cyclic counters, indexed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels added to a scroll position, taken off a scroll target, and the first section.
AHEAD, OFFSET, FIRST_SECTION = 200, 80, "meet-us"
#: Sections that are still compared by a broadcast; ranges of offsets that more are dealt to.
BROADCAST_SECTIONS, RANGES = 10_000, 200


def last_section(positions: DataFrame, sections: DataFrame, key: str, position: str, ahead: float = AHEAD) -> DataFrame:
    """(key, section): of sections (idx, id, offset_top) that start at most ``ahead`` beyond the position, that of the
    largest idx, whatever its offset; null if there is none. Sections without an offset don't exist yet and are passed over.

    Few sections are an array that each row searches. Many are dealt with the different positions to RANGES ranges of offsets: the largest
    idx so far runs along each range, from the largest of all ranges below. Null positions have no section.
    """
    real = sections.filter("offset_top is not null and idx is not null")
    where = F.col(position) + F.lit(ahead)
    if real.count() <= BROADCAST_SECTIONS:
        steps = real.agg(F.collect_list(F.struct("idx", "id", "offset_top")).alias("_steps"))
        x = positions.crossJoin(F.broadcast(steps))  # one row of at most BROADCAST_SECTIONS items
        reached = F.array_max(F.filter("_steps", lambda s: s["offset_top"] <= where))
        return x.select(key, reached["id"].alias("section"))
    # each different position is looked up once, then joined back: rows that share one, however many, are no hot task
    step = F.struct("idx", "id")
    none = F.lit(None).cast(real.select(step.alias("s")).schema["s"].dataType)
    asked = positions.select(where.cast("double").alias("_at")).filter("_at is not null").distinct().select("_at", F.lit(1).alias("_turn"), none.alias("_step"))
    known = real.groupBy(F.col("offset_top").cast("double").alias("_at")).agg(F.max(step).alias("_step")).select("_at", F.lit(0).alias("_turn"), "_step")
    both = known.unionByName(asked)
    bounds = sorted(set(both.approxQuantile("_at", [k / RANGES for k in range(1, RANGES)], 0.5 / RANGES)))
    ranged = lambda x: x.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_at"))))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged(known).groupBy("_range").agg(F.max("_step").alias("_most"))
    every = both.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_range"))
    first = every.join(first, "_range", "left").select("_range", F.max("_most").over(below).alias("_before"))
    along = Window.partitionBy("_range").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    x = ranged(both).withColumn("_so_far", F.max("_step").over(along)).filter("_turn = 1").join(F.broadcast(first), "_range", "left")
    best = x.select("_at", F.greatest("_so_far", "_before")["id"].alias("section"))
    return positions.select(F.col(key), where.cast("double").alias("_at")).join(best, "_at", "left").select(key, "section")


def carried_forward(rows: DataFrame, by: str, order: list[str], value: str, initial: object | None = None, bucket: Column | None = None) -> DataFrame:
    """``value`` with gaps filled by the last one before, or ``initial``; ordered within each ``by``.

    With ``bucket``, which must rise with ``order``, rows are filled inside the buckets of a key and from its buckets before, so that a
    key with very many rows is not one task.
    """
    parts = [by] if bucket is None else [by, "_bucket"]
    x = rows if bucket is None else rows.withColumn("_bucket", bucket)
    past = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(past)
    if bucket is not None:
        last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value"))))["_value"]
        before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
        ends = x.groupBy(*parts).agg(last.alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(before))
        ends = ends.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), "_before")
        x = x.withColumn("_own", filled).join(ends, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_b")))
        filled = F.coalesce("_own", "_before")
    filled = filled if initial is None else F.coalesce(filled, F.lit(initial))
    return x.withColumn(value, filled).select(*rows.columns)


def existing(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each id with what is found for it, null where nothing is."""
    return ids.join(found, key, "left")


def scroll_target(offset_top: Column, offset: float = OFFSET) -> Column:
    return offset_top - F.lit(offset)


def cycled(counter: Column, length: int) -> Column:
    """The position of a counter that starts again after ``length`` steps."""
    return F.pmod(counter, F.lit(length))


def item(items: Column, position: Column) -> Column:
    """0-based item, null outside."""
    return F.get(items, position)
