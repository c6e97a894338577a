"""The keyed record store as a stream: a change log in, each store's record out after every batch, with delayed removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lakeshore.operators.keyed_state import EXPIRY_MS, LIMIT
from lakeshore.sources.sinks import fanned_out

FIELDS = ("toast_id", "title", "description", "open")
RECORD = "toast_id string, title string, description string, open boolean"
OUT = f"store string, {RECORD}"
#: Stateful processors need a state store that has column families.
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(records: list[dict], expiries: dict[str, int], action: dict, limit: int = LIMIT, delay_ms: int = EXPIRY_MS) -> tuple[list[dict], dict[str, int]]:
    """One action applied to records, newest first, and to pending removals (id to due time, ms)."""
    kind, wanted, at = action["type"], action["toast_id"], action["at_ms"]
    if kind == "add":
        if wanted is None:
            return records, expiries
        new = {"toast_id": wanted, "title": action["title"], "description": action["description"], "open": True}
        return [new, *records][:limit], expiries
    if kind == "update":
        given = {f: action[f] for f in action["present"] or ()}
        return [r | given if r["toast_id"] == wanted else r for r in records], expiries
    if kind == "dismiss":
        asked = [wanted] if wanted else [r["toast_id"] for r in records]
        due = {i: at + delay_ms for i in asked if i not in expiries}  # the first request counts
        return [r | {"open": False} if wanted is None or r["toast_id"] == wanted else r for r in records], expiries | due
    if kind == "remove":
        return [r for r in records if wanted is not None and r["toast_id"] != wanted], expiries
    raise ValueError(f"unknown action {kind}")


class Store(StatefulProcessor):
    """One store's records as a list, its pending removals as a map from id to due time, and a timer for each of them.

    Rows are folded as they come, an Arrow batch at a time in order of seq; what is held in memory of a store is its state and that batch.
    By the event clock a removal is due by the time of its request and the watermark; by the wall clock by when its request is read, and
    pending removals also have a time to live, so that none stays in the state for good.
    """

    def __init__(self, limit: int, delay_ms: int, by_wall: bool) -> None:
        self.limit, self.delay_ms, self.by_wall = limit, delay_ms, by_wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", RECORD)
        # times to live need the wall clock; twice the delay leaves the timer to remove first
        self.removals = handle.getMapState("removals", "toast_id string", "due long", **({"ttlDurationMs": 2 * self.delay_ms} if self.by_wall else {}))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        records, due = self._state()
        was, before = records, due
        now = self._now(timerValues)
        for batch in rows:
            for row in batch.sort_values("seq", kind="stable").itertuples(index=False):
                action = {k: plain(v) for k, v in row._asdict().items()}
                if self.by_wall:
                    action["at_ms"] = now
                records, due = due_removed(records, due, action["at_ms"])
                records, due = folded(records, due, action, self.limit, self.delay_ms)
        records, due = due_removed(records, due, now)
        self._keep(was, before, records, due)
        yield shown(key[0], records)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        was, before = self._state()
        records, due = due_removed(was, before, self._now(timerValues))
        if due != before:  # the first timer of a watermark removes all that is due
            self._keep(was, before, records, due)
            yield shown(key[0], records)

    def _now(self, timerValues: TimerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs() if self.by_wall else timerValues.getCurrentWatermarkInMs()

    def _state(self) -> tuple[list[dict], dict[str, int]]:
        records = [dict(zip(FIELDS, row)) for row in self.records.get()] if self.records.exists() else []
        return records, {key[0]: value[0] for key, value in self.removals.iterator()} if self.removals.exists() else {}

    def _keep(self, was: list[dict], before: dict[str, int], records: list[dict], due: dict[str, int]) -> None:
        """Write what has changed."""
        if records != was:
            self.records.put([tuple(r[f] for f in FIELDS) for r in records]) if records else self.records.clear()
        for gone in before.keys() - due.keys():
            self.removals.removeKey((gone,))
        for name, at in due.items():
            if before.get(name) != at:
                self.removals.updateValue((name,), (at,))
        for at in set(before.values()) - set(due.values()):
            self.handle.deleteTimer(at)
        for at in set(due.values()) - set(before.values()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def plain(value: object) -> object:
    """What a column holds: lists for arrays, None for what pandas has in place of null."""
    if isinstance(value, (list, np.ndarray)):
        return list(value)
    return None if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value) else value


def shown(store: str, records: list[dict]) -> pd.DataFrame:
    """The rows that a store puts out."""
    rows = records or [dict.fromkeys(FIELDS)]
    return pd.DataFrame([{"store": store} | r for r in rows], columns=["store", *FIELDS])


def store_stream(actions: DataFrame, limit: int = LIMIT, delay_ms: int = EXPIRY_MS, clock: str = "event") -> DataFrame:
    """Records of each store after each batch of ``actions`` (store, seq, at timestamp, type, toast_id, title, description, open,
    present), in update mode; a store without records gives one row of nulls.

    State is bounded by ``limit`` and the pending removals of a store, and kept in RocksDB, which this sets for the session. ``clock`` drives
    the removals: ``event`` by ``at``, which needs a watermark then, or ``wall``. As in the store itself the order of arrival counts: rows of an Arrow batch are put in order of seq, later batches
    come after it, so a log that keeps a store's actions in order (:mod:`lakeshore.sources.eventlog`) is folded in that order.
    """
    actions.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)
    timed = actions.withColumn("at_ms", F.unix_millis("at"))
    if clock not in ("event", "wall"):
        raise ValueError(f"clock is event or wall, not {clock}")
    by_wall = clock == "wall"
    return timed.groupBy("store").transformWithStateInPandas(Store(limit, delay_ms, by_wall), OUT, "update", "processingTime" if by_wall else "eventTime")


def due_removed(records: list[dict], expiries: dict[str, int], now_ms: int) -> tuple[list[dict], dict[str, int]]:
    """Remove what is due."""
    due = {i for i, at in expiries.items() if at <= now_ms}
    return [r for r in records if r["toast_id"] not in due], {i: at for i, at in expiries.items() if i not in due}


def run_to_end(stream: DataFrame, folder: str, listeners: Sequence[Callable[[DataFrame, int], None]], mode: str = "update") -> None:
    """Everything that ``stream`` has by now, batch by batch, to each of ``listeners``; the state is kept below ``folder``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(fanned_out(listeners))
    writer.trigger(availableNow=True).start().awaitTermination()


def run_while_available(stream: DataFrame, folder: str, listeners: Sequence[Callable[[DataFrame, int], None]], mode: str = "append") -> None:
    """Like :func:`run_to_end` for sources that deal out their own batches: batch after batch until nothing is left, with one more when a
    later watermark closes what is open."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(fanned_out(listeners))
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def batches_to(folder: str) -> Callable[[DataFrame, int], None]:
    """A listener that writes each batch to ``folder``/batch=number; a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def ticker(ticks: DataFrame, lengths: dict[str, int], tick: str = "value") -> DataFrame:
    """A row for each tick (such as of the ``rate`` source, triggered every 3 s): the position of each slideshow."""
    return ticks.select(tick, *[F.pmod(F.col(tick), F.lit(n)).cast("int").alias(name) for name, n in lengths.items()])
