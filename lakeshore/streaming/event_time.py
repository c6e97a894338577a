"""Windows and joins by event time, for streams and for tables alike: on a stream they close as the watermark passes them.

A window is put out once the watermark (the latest event time seen, less the delay) has reached its end, and never again; its state is
dropped then. A row that comes when its window has closed is late and is dropped: in batch b that is a row whose window ends at or before the
watermark of batches up to b - 2, as Spark drops late rows by the watermark that the batch before began with. On a table nothing is
late and every window comes out.

Cases: rows without an event time are in no window and no join; a null key is a key of its own in windows and joins nothing, though it
keeps its row in an outer join; equal rows count as often as they occur; an empty stream or table gives no window; a hot key is combined
before each shuffle in windows, and spread over time buckets in joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial sessions are merged before the shuffle too, so that a hot key sends a row for each session, not for each event.
LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def timed(events: DataFrame, at: str, delay: str, name: str = "at") -> DataFrame:
    """``events`` with ``at`` as a timestamp column ``name`` that carries a watermark; rows without one go. Columns without a zone are
    read in the session's zone: watermarks can't be set on them."""
    return events.withColumn(name, F.col(at).cast("timestamp")).filter(F.col(name).isNotNull()).withWatermark(name, delay)


def _bounded(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *[c for c in grouped.columns if c != "_window"])


def windowed(events: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], length: str, step: str | None = None, at: str = "at") -> DataFrame:
    """(window_start, window_end, keys, aggregates) of windows of ``length``, one after the other or one each ``step``."""
    grouped = events.groupBy(F.window(at, length, step or length).alias("_window"), *keys).agg(*aggregates)
    return _bounded(grouped)


def sessions(events: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], gap: str, at: str = "at") -> DataFrame:
    """(window_start, window_end, keys, aggregates) of sessions: events of a key less than ``gap`` apart; a session ends ``gap`` after its last event,
    and sessions that an event between them connects become one."""
    events.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    grouped = events.groupBy(F.session_window(at, gap).alias("_window"), *keys).agg(*aggregates)
    return _bounded(grouped)


def followed(first: DataFrame, then: DataFrame, key: str, within_s: int, at: str = "at", how: str = "left") -> DataFrame:
    """Each row of ``first`` with each row of ``then`` of the same key at its time or up to ``within_s`` seconds later; columns of ``then`` are
    named then_*. ``how``: inner, or left for rows of ``first`` that nothing follows, too, which a stream puts out when nothing can follow any more.

    Rows meet by key and time bucket of ``within_s`` seconds: one of ``then`` is in its own bucket and the one before, one of ``first`` in its
    own only, so each pair meets once and a hot key is spread over its buckets. Both sides need a watermark on a stream.
    """
    bucket = F.floor(F.unix_micros(at) / F.lit(within_s * 1_000_000))
    left = first.withColumn("_bucket", bucket)
    renamed = then.select(*[F.col(c).alias(f"then_{c}") for c in then.columns], F.explode(F.array(bucket, bucket - 1)).alias("_then_bucket"))
    near = F.col(f"then_{at}").between(F.col(at), F.col(at) + F.expr(f"INTERVAL {within_s} SECONDS"))
    met = left.join(renamed, (F.col(key) == F.col(f"then_{key}")) & (F.col("_bucket") == F.col("_then_bucket")) & near, how)
    return met.drop("_bucket", "_then_bucket")


def deduplicated(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each of ``keys`` that comes, as long as the watermark hasn't passed its time; its copies are dropped, and so are rows that
    come later than that. State is a row for each key within the delay. A null key is a key; on a table any one row of a key stays."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))
