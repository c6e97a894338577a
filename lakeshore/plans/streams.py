"""Queries that run the table ``events`` as a log through a stream, batch by batch, each with the SQL of what must come out.

Windows, sessions and joins by event time have no counterpart in the reference: they are of the driver's contract.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.plans.catalog import REGISTRY
from lakeshore.sources import eventlog, sinks
from lakeshore.sources.tables import table
from lakeshore.streaming import event_time, store

#: Batches that a log is replayed in, and by how much the watermark stays behind.
BATCHES, DELAY = 5, "2 hours"


def replayed(spark: SparkSession, events: DataFrame, folder: str, order: str = "event_id") -> DataFrame:
    """``events``, in ``order``, as a stream of BATCHES batches of equally many rows."""
    eventlog.appended(events, f"{folder}/log", [order])
    rows = -(-events.count() // BATCHES)
    return eventlog.streamed(spark, f"{folder}/log", events.schema, max(1, rows))


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """All batches that ``stream`` puts out, with their numbers."""
    spark, out = stream.sparkSession, f"{folder}/out"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    store.run_while_available(stream, folder, [store.batches_to(out)])
    return spark.read.schema(f"{schema}, batch int").option("basePath", out).parquet(out)


def with_late(events: DataFrame) -> DataFrame:
    """``events`` with a time ``at``; every fortieth comes ten days after it happened."""
    return events.withColumn("at", F.when(F.col("event_id") % 40 == 7, F.col("ts") - F.expr("INTERVAL 10 DAYS")).otherwise(F.col("ts")))


def plain(columns: list[str]) -> list:
    """Times without a zone, as the tables have them."""
    return [F.col(c).cast("timestamp_ntz").alias(c) if c.endswith(("start", "end", "at")) else F.col(c) for c in columns]


BATCH_SQL = f"(row_number() OVER (ORDER BY event_id) - 1) // ceil(count(*) OVER () / {BATCHES}.0)::BIGINT"
#: Of each batch the watermark by which its late rows are dropped (null for none), and the last watermark of all.
WATERMARK_SQL = f"""
e AS (SELECT *, CASE WHEN event_id % 40 = 7 THEN ts - INTERVAL 10 DAY ELSE ts END AS seen, {BATCH_SQL} AS b FROM events),
w AS (SELECT b, date_trunc('millisecond', max(max(seen)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 2 HOUR AS late FROM e GROUP BY b),
f AS (SELECT date_trunc('millisecond', max(seen)) - INTERVAL 2 HOUR AS last FROM e)"""


@REGISTRY.register("event_log_stream", f"SELECT event_id, event_type, ({BATCH_SQL})::INT AS batch FROM events")
def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in exactly one batch, in the log's order."""
    folder = own_folder(spark, "event-log")
    stream = replayed(spark, table(spark, sf_dir, "events"), folder)
    return collected(stream.select("event_id", "event_type"), folder).select("event_id", "event_type", "batch")


@REGISTRY.register(
    "tumbling_windows",
    f"""
    WITH {WATERMARK_SQL}, x AS (SELECT e.*, time_bucket(INTERVAL 1 HOUR, seen) AS window_start FROM e JOIN w USING (b)
                               WHERE late IS NULL OR time_bucket(INTERVAL 1 HOUR, seen) + INTERVAL 1 HOUR > late)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM x
    GROUP BY window_start, event_type HAVING window_start + INTERVAL 1 HOUR <= (SELECT last FROM f)
    """,
)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "tumbling")
    stream = event_time.timed(replayed(spark, with_late(table(spark, sf_dir, "events")), folder), "at", DELAY)
    closed = event_time.windowed(stream, ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")], "1 hour")
    return collected(closed, folder).select(*plain(["window_start", "window_end", "event_type", "n"]), F.round("total", 2).alias("total"))


@REGISTRY.register(
    "sliding_windows",
    f"""
    WITH {WATERMARK_SQL}, x AS (SELECT e.*, time_bucket(INTERVAL 1 HOUR, seen) - INTERVAL 1 HOUR * k AS window_start, late FROM e JOIN w USING (b), range(3) r(k))
    SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, event_type, count(*) AS n, max(value) AS most FROM x
    WHERE late IS NULL OR window_start + INTERVAL 3 HOUR > late GROUP BY window_start, event_type HAVING window_start + INTERVAL 3 HOUR <= (SELECT last FROM f)
    """,
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "sliding")
    stream = event_time.timed(replayed(spark, with_late(table(spark, sf_dir, "events")), folder), "at", DELAY)
    closed = event_time.windowed(stream, ["event_type"], [F.count("*").alias("n"), F.max("value").alias("most")], "3 hours", "1 hour")
    return collected(closed, folder).select(*plain(["window_start", "window_end", "event_type", "n", "most"]))


@REGISTRY.register(
    "session_windows",
    """
    WITH o AS (SELECT *, coalesce(ts > lag(ts) OVER u + INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM o)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s
    GROUP BY user_id, number HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)
    """,
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "sessions")
    stream = event_time.timed(replayed(spark, table(spark, sf_dir, "events"), folder), "ts", DELAY)
    kinds = F.size(F.collect_set("event_type")).cast("long").alias("kinds")
    closed = event_time.sessions(stream, ["user_id"], [F.count("*").alias("n"), kinds], "30 minutes")
    return collected(closed, folder).select(*plain(["window_start", "window_end", "user_id", "n", "kinds"]))


@REGISTRY.register("deduplicated_stream", "SELECT event_id, user_id, event_type FROM events")
def deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every fifth event comes again, some in the batch of the first time and some in the next one; each comes out once."""
    folder = own_folder(spark, "deduplicated")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", (F.col("event_id") * 10).alias("place"))
    again = events.filter("event_id % 5 = 0").withColumn("place", F.col("place") + 1005)
    stream = event_time.timed(replayed(spark, events.unionByName(again), folder, "place"), "ts", DELAY)
    return collected(event_time.deduplicated(stream, ["event_id"]).select("event_id", "user_id", "event_type"), folder).drop("batch")


@REGISTRY.register(
    "interval_join_stream",
    """
    WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    f AS (SELECT date_trunc('millisecond', least((SELECT max(ts) FROM v), (SELECT max(ts) FROM p))) - INTERVAL 2 HOUR AS last)
    SELECT v.event_id, p.event_id AS bought, p.ts AS bought_at FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR
    WHERE p.event_id IS NOT NULL OR v.ts + INTERVAL 1 HOUR < (SELECT last FROM f)
    """,
)
def interval_join_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the same user's purchases within an hour; a view that nothing follows comes out once its hour has passed."""
    folder = own_folder(spark, "interval-join")
    log = replayed(spark, table(spark, sf_dir, "events"), folder).select("event_id", "ts", "user_id", "event_type")
    views = event_time.timed(log.filter("event_type = 'view'"), "ts", DELAY).select("event_id", "user_id", "at")
    bought = event_time.timed(log.filter("event_type = 'purchase'"), "ts", DELAY).select("event_id", "user_id", "at")
    met = event_time.followed(views, bought, "user_id", 3600)
    return collected(met.select("event_id", F.col("then_event_id").alias("bought"), F.col("then_at").alias("bought_at")), folder).select(*plain(["event_id", "bought", "bought_at"]))
