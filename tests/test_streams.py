"""Event-time windows, joins and the event log: late rows, odd rows, empty logs, and a query that comes back."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeshore.sources import eventlog
from lakeshore.streaming import event_time, store

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, at timestamp, user_id long, kind string"


def minute(k):
    return T0 + dt.timedelta(minutes=k)


def log(spark, folder, rows, per_batch):
    eventlog.appended(spark.createDataFrame(rows, EVENTS), f"file://{folder}/log", ["event_id"])
    return eventlog.streamed(spark, f"file://{folder}/log", spark.createDataFrame([], EVENTS).schema, per_batch)


def put_out(stream, folder, mode="append"):
    rows = []
    store.run_while_available(stream, f"file://{folder}/run", [lambda batch, number: rows.extend((number, *r) for r in batch.collect())], mode)
    return rows


def test_log_comes_back_without_a_lost_or_doubled_event(spark, tmp_path):
    stream = log(spark, tmp_path, [(k, minute(k), 1, "a") for k in range(10)], 4).select("event_id")
    failed, seen = [], []

    def fails_once(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost the sink")
        seen.extend((number, r.event_id) for r in batch.collect())

    with pytest.raises(Exception, match="lost the sink"):
        store.run_while_available(stream, f"file://{tmp_path}/run", [fails_once])
    eventlog.appended(spark.createDataFrame([(k, minute(k), 1, "a") for k in range(10, 15)], EVENTS), f"file://{tmp_path}/log", ["event_id"])
    store.run_while_available(stream, f"file://{tmp_path}/run", [fails_once])
    assert sorted(e for _, e in seen) == list(range(15))
    assert [e for n, e in sorted(seen) if n == 1] == [4, 5, 6, 7]  # the batch that failed is the same again
    store.run_while_available(stream, f"file://{tmp_path}/run", [fails_once])
    assert len(seen) == 15


def test_log_reads_slices_of_files(spark, tmp_path):
    rows = [(k, None if k % 3 else minute(k), None if k % 4 else k, "a") for k in range(50)]
    eventlog.appended(spark.createDataFrame(rows, EVENTS), f"file://{tmp_path}/log", ["event_id"], partitions=4)
    eventlog.appended(spark.createDataFrame(rows[:3], EVENTS), f"file://{tmp_path}/log", ["event_id"], partitions=1)
    reader = eventlog.LogReader(f"file://{tmp_path}/log", 20, 7, StructType.fromDDL("user_id long, event_id long"))
    got, at = [], reader.initialOffset()
    while (to := reader.latestOffset()) != at:
        parts = reader.partitions(at, to)
        assert all(p.end - p.start <= 7 for p in parts)
        got.append([tuple(r.values()) for p in parts for batch in reader.read(p) for r in batch.to_pylist()])
        at = to
    assert [len(b) for b in got] == [20, 20, 13]
    assert [r for b in got for r in b] == [(r[2], r[0]) for r in rows + rows[:3]]
    empty = eventlog.LogReader(f"file://{tmp_path}/none", 20, 7, StructType.fromDDL("event_id long"))
    assert empty.latestOffset() == empty.initialOffset() and list(empty.partitions({"rows": 0}, {"rows": 0})) == []


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    rows = [(k, minute(30 * k), 1, "a") for k in range(8)]  # 0:00 to 3:30, two rows a batch
    rows[6] = (6, minute(20), 1, "late")  # batch 3: the watermark of batch 1 (1:30) has passed its window
    rows[4] = (4, minute(95), 1, "not too late")
    rows += [(8, None, 1, "no time"), (9, minute(500), None, "a"), (10, minute(500), None, "a"), (11, minute(1000), 2, "a")]
    stream = event_time.timed(log(spark, tmp_path, rows, 2), "at", "0 seconds")
    got = put_out(event_time.windowed(stream, ["user_id"], [F.count("*").alias("n")], "1 hour"), tmp_path)
    of = {(r[1], r[3]): r[4] for r in got}
    hour = lambda k: minute(60 * k)
    assert of == {(hour(0), 1): 2, (hour(1), 1): 3, (hour(2), 1): 1, (hour(3), 1): 1, (hour(8), None): 2}
    assert len(got) == len(of)  # each window once; that of the last event is still open
    table = event_time.windowed(event_time.timed(spark.createDataFrame(rows, EVENTS), "at", "0 seconds"), ["user_id"], [F.count("*").alias("n")], "1 hour")
    assert sum(r.n for r in table.collect()) == 11  # a table has no late rows


def test_sessions_merge_over_batches(spark, tmp_path):
    rows = [(0, minute(0), 1, "a"), (1, minute(0), 1, "a"), (2, minute(40), 1, "a"), (3, minute(20), 1, "a"), (4, minute(20), 2, "a"), (5, minute(51), 2, "a"), (6, minute(900), 3, "a"), (7, minute(901), None, "a")]
    stream = event_time.timed(log(spark, tmp_path, rows, 2), "at", "2 hours")
    got = put_out(event_time.sessions(stream, ["user_id"], [F.count("*").alias("n")], "30 minutes"), tmp_path)
    assert sorted(r[1:] for r in got) == [(minute(0), minute(70), 1, 4), (minute(20), minute(50), 2, 1), (minute(51), minute(81), 2, 1)]
    table = event_time.sessions(event_time.timed(spark.createDataFrame(rows, EVENTS), "at", "2 hours"), ["user_id"], [F.count("*").alias("n")], "30 minutes")
    assert table.count() == 5


def followed(first, then, within=3600):
    """By hand: (event_id, id that follows or None)."""
    out = []
    for a in first:
        hits = [b[0] for b in then if None not in (a[1], b[1], a[2], b[2]) and a[2] == b[2] and 0 <= (b[1] - a[1]).total_seconds() <= within]
        out += [(a[0], h) for h in hits] or [(a[0], None)]
    return sorted(out, key=str)


ROWS = [(0, minute(0), 1, "v"), (1, minute(0), 1, "p"), (2, minute(60), 1, "p"), (3, minute(61), 1, "p"), (4, minute(59), 1, "v"), (5, minute(59), 1, "v"),
        (6, minute(70), None, "v"), (7, minute(70), None, "p"), (8, minute(119), 1, "p"), (9, minute(121), 2, "v"), (10, minute(121), 3, "p")]


def test_table_join_by_time(spark):
    events = spark.createDataFrame([*ROWS, (11, None, 1, "v"), (12, None, 1, "p")], EVENTS)
    met = event_time.followed(events.filter("kind = 'v'"), events.filter("kind = 'p'"), "user_id", 3600)
    assert met.columns == ["event_id", "at", "user_id", "kind", "then_event_id", "then_at", "then_user_id", "then_kind"]
    rows = [*ROWS, (11, None, 1, "v"), (12, None, 1, "p")]
    want = followed([r for r in rows if r[3] == "v"], [r for r in rows if r[3] == "p"])
    assert sorted(((r.event_id, r.then_event_id) for r in met.collect()), key=str) == want
    inner = event_time.followed(events.filter("kind = 'v'"), events.filter("kind = 'p'"), "user_id", 3600, how="inner")
    assert sorted(((r.event_id, r.then_event_id) for r in inner.collect()), key=str) == [w for w in want if w[1] is not None]
    assert "NestedLoop" not in inner._jdf.queryExecution().toString()
    assert event_time.followed(events.limit(0), events, "user_id", 60).count() == 0


def test_stream_join_by_time(spark, tmp_path):
    closing = [(13, minute(2000), 9, "v"), (14, minute(2000), 9, "p"), (15, minute(2001), 9, "x")]
    stream = event_time.timed(log(spark, tmp_path, [*ROWS, *closing], 4), "at", "1 hour")
    met = event_time.followed(stream.filter("kind = 'v'"), stream.filter("kind = 'p'"), "user_id", 3600)
    got = put_out(met.select("event_id", "then_event_id"), tmp_path)
    rows = [*ROWS, *closing]
    assert sorted((r[1:] for r in got), key=str) == followed([r for r in rows if r[3] == "v"], [r for r in rows if r[3] == "p"])


def test_copies_within_the_watermark_come_out_once(spark, tmp_path):
    rows = [(1, minute(0), 1, "a"), (1, minute(0), 1, "a"), (2, minute(1), None, "a"), (3, minute(2), None, "a"), (1, minute(30), 1, "b"), (4, minute(200), 5, "a"), (5, minute(201), 6, "a"), (6, minute(202), 7, "a"), (7, minute(1), 8, "late")]
    eventlog.appended(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"place long, {EVENTS}"), f"file://{tmp_path}/log", ["place"])
    log_ = eventlog.streamed(spark, f"file://{tmp_path}/log", StructType.fromDDL(f"place long, {EVENTS}"), 2)
    got = put_out(event_time.deduplicated(event_time.timed(log_, "at", "1 hour"), ["user_id"]).select("place", "user_id"), tmp_path)
    assert sorted((r[2] or 0) for r in got) == [0, 1, 5, 6, 7]  # one of each key, null too, and not the late one
    table = event_time.deduplicated(event_time.timed(spark.createDataFrame(rows, EVENTS), "at", "1 hour"), ["user_id"])
    assert table.count() == 6


def test_empty_log(spark, tmp_path):
    stream = event_time.timed(log(spark, tmp_path, [], 4), "at", "1 hour")
    assert put_out(event_time.windowed(stream, ["user_id"], [F.count("*").alias("n")], "1 hour"), tmp_path) == []


def test_timers_remove_what_is_due(spark, tmp_path):
    columns = "store string, seq long, at timestamp, type string, toast_id string, title string, description string, open boolean, present array<string>"
    second = lambda k: T0 + dt.timedelta(seconds=k)
    act = lambda store_, seq, at, kind, wanted: (store_, seq, second(at), kind, wanted, f"t{seq}", None, None, ["title"])
    actions = [act("x", 0, 0, "add", "1"), act("x", 1, 1, "add", "2"), act("x", 2, 2, "dismiss", "1"), act("y", 3, 2, "add", "9"),
               act("x", 4, 60, "dismiss", "1"), act("x", 5, 300, "dismiss", "2"), act("y", 6, 301, "add", None), act("y", 7, 302, "remove", "nothing"),
               act("y", 8, 1100, "update", "9"), act("y", 9, 1101, "dismiss", None), act("z", 10, 1200, "add", "5"), act("z", 11, 1250, "add", "6"),
               act("z", 12, 1900, "update", "5"), act("z", 13, 1901, "update", "5"), act("z", 14, 1902, "remove", "6"), act("z", 15, 1903, "dismiss", "")]
    eventlog.appended(spark.createDataFrame(actions, columns), f"file://{tmp_path}/log", ["seq"])
    stream = eventlog.streamed(spark, f"file://{tmp_path}/log", spark.createDataFrame([], columns).schema, 4)
    rows = put_out(store.store_stream(stream.withWatermark("at", "0 seconds"), limit=2, delay_ms=1_000_000), tmp_path, "update")
    shown = {}
    for number, name, *record in rows:
        shown.setdefault(number, {}).setdefault(name, []).append((record[0], record[1], record[3]))
    none = [(None, None, None)]
    assert shown[0] == {"x": [("2", "t1", True), ("1", "t0", False)], "y": [("9", "t3", True)]}
    assert shown[1] == {"x": [("2", "t1", False), ("1", "t0", False)], "y": [("9", "t3", True)]}
    assert shown[2]["y"] == [("9", "t8", False)] and shown[2]["z"] == [("6", "t11", True), ("5", "t10", True)]
    # 1250 s: the first request for 1 was due at 1002 s (a second one moved nothing), that for 2 is at 1300 s
    gone = {name: records for number in sorted(shown) for name, records in shown[number].items()}
    assert [shown[n]["x"] for n in sorted(shown) if "x" in shown[n]][-2:] == [[("2", "t1", False)], none]
    assert gone == {"x": none, "y": [("9", "t8", False)], "z": [("5", "t13", True)]}  # an empty id asks for removals, but closes none


def test_removals_by_the_wall_clock(spark, tmp_path):
    columns = "store string, seq long, at timestamp, type string, toast_id string, title string, description string, open boolean, present array<string>"
    actions = [("x", 0, T0, "add", "1", "t", None, None, []), ("x", 1, T0, "dismiss", "1", None, None, None, []), ("y", 2, T0, "add", "2", "u", None, None, [])]
    eventlog.appended(spark.createDataFrame(actions, columns), f"file://{tmp_path}/log", ["seq"])
    stream = eventlog.streamed(spark, f"file://{tmp_path}/log", spark.createDataFrame([], columns).schema, 10)
    seen = []
    query = store.store_stream(stream, delay_ms=3000, clock="wall").writeStream.outputMode("update").foreachBatch(lambda batch, _: seen.extend(batch.collect()))
    query = query.option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and not any(r.store == "x" and r.toast_id is None for r in seen):
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.toast_id, r.open) for r in seen if r.store == "x"] == [("1", False), (None, None)]
    assert [(r.toast_id, r.open) for r in seen if r.store == "y"] == [("2", True)]
    with pytest.raises(ValueError, match="event or wall"):
        store.store_stream(stream, clock="none")
