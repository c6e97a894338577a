"""Sinks: key-value records with an age, logs of unmatched rows, and fan-out of each batch."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: seconds that a stored value lives (7 days).
MAX_AGE_S = 60 * 60 * 24 * 7
#: Paths of a batch that are logged one by one; all are written.
LOGGED = 20


def stored(rows: DataFrame, key: str, value: str, at: str, max_age_s: int = MAX_AGE_S) -> DataFrame:
    """(key, value, expires): the last value of each key, to be written by any writer."""
    last = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("last"))
    return last.select("key", "last.value", (F.col("last.at") + F.expr(f"INTERVAL {max_age_s} SECONDS")).alias("expires"))


def unmatched_logged(name: str = "lakeshore.routes", folder: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: counts a batch's unmatched paths and writes all counts (path, count) to ``folder``/batch=number,
    by default a new folder below ``spark.checkpoint.dir``; a repeated batch replaces its own.

    The LOGGED most frequent ones are also logged; where there are more, so is how many and where all are.
    """
    own = f"unmatched-{uuid.uuid4().hex}"

    def log(batch: DataFrame, number: int) -> None:
        spark, logger = batch.sparkSession, logging.getLogger(name)
        counts = batch.groupBy("path").count()
        path = f"{folder or f'{shared_folder(spark)}/{own}'}/batch={number}"
        counts.write.mode("overwrite").parquet(path)
        kept = spark.read.schema(counts.schema).parquet(path)
        for r in kept.orderBy(F.desc("count"), "path").limit(LOGGED).collect():
            logger.error("no route for %s (%d times, batch %d)", r.path, r["count"], number)
        if (more := kept.count() - LOGGED) > 0:
            logger.error("no route for %d more paths (batch %d), all of them in %s", more, number, path)

    return log


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, a new local one is set if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lakeshore-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fanned_out(listeners: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands each batch to every listener; the list may change between batches."""

    def hand_out(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for listener in list(listeners):
                listener(kept, number)
        finally:
            kept.unpersist()

    return hand_out
