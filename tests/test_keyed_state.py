import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeshore.operators import keyed_state as ks
from lakeshore.streaming import store


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_newest_and_limit(spark):
    df = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b"), (None, "n")], "seq int, id string")
    assert rows(ks.newest(df, "seq")) == [(3, "c")]
    assert len(rows(ks.newest(df, "seq", 9))) == 4


def test_update_keeps_absent_fields_and_takes_present_nulls(spark):
    df = spark.createDataFrame([("1", "t", True), ("2", "u", None), (None, "n", True)], "id string, title string, open boolean")
    up = spark.createDataFrame([("1", None, False, ["title"]), ("9", "x", True, ["title", "open"]), ("2", None, None, None)], "id string, title string, open boolean, present array<string>")
    assert rows(ks.updated(df, up, "id", ["title", "open"], "present")) == rows(spark.createDataFrame([("1", None, True), ("2", "u", None), (None, "n", True)], df.schema))


def test_close_and_delete_one_or_all(spark):
    df = spark.createDataFrame([("1", True), ("2", True), (None, True)], "id string, open boolean")
    assert rows(ks.closed(df, "id", "1")) == rows(spark.createDataFrame([("1", False), ("2", True), (None, True)], df.schema))
    assert all(r.open is False for r in ks.closed(df, "id", None).collect())
    assert rows(ks.deleted(df, "id", "1")) == rows(spark.createDataFrame([("2", True), (None, True)], df.schema))
    assert ks.deleted(df, "id", None).count() == 0
    assert ks.deleted_keys(df, df.filter("id = '2'"), "id").count() == 2


def test_first_request_sets_the_expiry(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + dt.timedelta(seconds=5)), ("a", t), (None, t)], "id string, at timestamp")
    (row,) = ks.first_expiry(df, "id", "at").collect()
    assert row.requested == t and row.expires - t == dt.timedelta(milliseconds=ks.EXPIRY_MS)


def test_dense_ids_wrap(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    got = {r.k: r.id for r in ks.dense_ids(df, ["k"], F.floor(F.col("k") / 100), modulus=100).collect()}
    assert got == {k: str((i + 1) % 100) for i, k in enumerate(range(0, 1000, 7))}


def test_requests_go_through_the_last_handle(spark):
    t = dt.datetime(2024, 1, 1)
    asks = [(0, "x", "click"), (1, "x", "raise"), (2, "y", "raise"), (3, "x", "click"), (4, "x", "raise"), (5, "x", "click"), (6, "y", "click"), (7, None, "click"), (8, None, "raise"), (9, None, "click")]
    df = spark.createDataFrame([(k, s, a, t + dt.timedelta(hours=9 * k)) for k, s, a in asks], "seq long, store string, ask string, at timestamp")
    got = ks.handled(df, "store", "seq", F.col("ask") == "raise", F.floor(F.col("seq") / 3), F.to_date("at"))
    assert got.columns == [*df.columns, "toast_id"]
    assert {r.seq: r.toast_id for r in got.collect()} == {0: None, 1: "1", 2: "2", 3: "1", 4: "3", 5: "3", 6: "2", 7: None, 8: "4", 9: "4"}
    assert ks.handled(df.limit(0), "store", "seq", F.col("ask") == "raise", F.col("seq"), F.to_date("at")).count() == 0


def test_dispatch_unknown_type(spark):
    df = spark.createDataFrame([("add",), ("zap",), (None,)], "type string")
    assert [r[0] for r in df.select(ks.dispatched(F.col("type"), {"add": F.lit(1)}, F.lit(0))).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(ks.dispatched(F.col("type"), {}, F.lit(0))).collect()] == [0, 0, 0]


LOG = "store string, seq int, at timestamp, type string, toast_id string, title string, description string, open boolean, present array<string>"


def log(n=300):
    rng, out = random.Random(7), []
    for k in range(n):
        kind = rng.choice(["add", "update", "dismiss", "remove", "update", "dismiss"])
        wanted = rng.choice(["1", "2", None]) if kind in ("dismiss", "remove") else rng.choice(["1", "2"])
        present = rng.choice([["title"], ["title", "description"], ["open"], []])
        out.append((rng.choice("xyz"), k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), kind, wanted, rng.choice(["t", "u", None]), rng.choice(["d", None]), rng.choice([True, None]), present))
    return out


def expected(actions):
    state = {}
    for s, _, at, kind, wanted, title, description, open_, present in actions:
        action = {"type": kind, "toast_id": wanted, "title": title, "description": description, "open": open_, "present": present, "at_ms": int(at.timestamp() * 1000)}
        state[s] = store.folded(*state.get(s, ([], {})), action)
    return sorted(((s, *r.values()) for s, (records, _) in state.items() for r in records), key=str)


@pytest.mark.parametrize("n", [3, 17, 60, 300])
def test_replay_is_the_fold(spark, n):
    actions = log(n)
    got = ks.replayed(spark.createDataFrame(actions, LOG).repartition(3)).select("store", "toast_id", "title", "description", "open")
    assert rows(got) == expected(actions)


def test_fold_edges():
    add = {"type": "add", "toast_id": "1", "title": "t", "description": None, "at_ms": 0}
    records, due = store.folded([], {}, add)
    records, due = store.folded(records, due, {"type": "dismiss", "toast_id": "", "at_ms": 5})
    assert records[0]["open"] is True and due == {"1": 5 + ks.EXPIRY_MS}  # an empty id asks for all removals, but closes none
    _, again = store.folded(records, due, {"type": "dismiss", "toast_id": "1", "at_ms": 9})
    assert again == due
    assert store.due_removed(records, due, 5 + ks.EXPIRY_MS) == ([], {})
    assert store.folded(records, due, add | {"toast_id": "2"})[0] == [{"toast_id": "2", "title": "t", "description": None, "open": True}]


def test_stream_of_actions(spark, tmp_path):
    actions = log(40)
    source, shown = str(tmp_path / "in"), {}
    frame = spark.createDataFrame(actions, LOG)
    for a, b in ((0, 15), (15, 40)):
        frame.filter(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source).withWatermark("at", "1 hour")

    def keep(batch, _):
        for r in batch.collect():
            shown[r.store] = r

    query = store.store_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted([(s, *r[1:]) for s, r in shown.items() if r.toast_id], key=str)
    assert got == expected(actions)


def test_delete_one_counts_what_is_left(spark, tmp_path):
    import duckdb

    from lakeshore.plans import catalog

    query, sql = catalog.REGISTRY.queries["keyed_delete_one"], catalog.REGISTRY.oracles["keyed_delete_one"]
    for name, keys, want in (("some", [5, 7, 7, 9, 9, None], [(5, 3), (9, 3), (9, 3)]), ("none", [7, None], []), ("empty", [], [])):
        spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"file://{tmp_path}/{name}/orders.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/{name}/orders.parquet/*.parquet'")
        assert sorted(map(tuple, query(spark, f"file://{tmp_path}/{name}").select("o_orderkey", "n_left").collect())) == want
        assert sorted(con.sql(sql).select("o_orderkey, n_left").fetchall()) == want
