"""Queries of the driver's contract that the reference has no counterpart for: intervals, groupings, JSON, sketches, table functions, counted
set operations, frames by time, and the SQL surface. Each has its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions import semistructured, table_functions
from lakeshore.operators import grouping, intervals, ranking, sketches
from lakeshore.plans import catalog
from lakeshore.plans.catalog import REGISTRY
from lakeshore.plans.sql import SQL_QUERIES, surface
from lakeshore.sources import sinks
from lakeshore.sources.tables import table

SPANS_SQL = """
v AS (SELECT event_id, user_id, ts AS s, ts + to_milliseconds((value * 60000)::BIGINT) AS e FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, user_id, ts AS s, ts + to_milliseconds((value * 6000000)::BIGINT) AS e FROM events WHERE event_type = 'purchase')"""


@REGISTRY.register(
    "interval_overlap",
    f"WITH {SPANS_SQL} SELECT v.event_id, p.event_id AS other_event_id, v.user_id FROM v JOIN p ON v.user_id = p.user_id AND v.s <= p.e AND p.s <= v.e",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of up to some hours and a user's purchases of up to some days whose times overlap."""
    events = table(spark, sf_dir, "events")

    def lasting(kind: str, factor: int) -> DataFrame:
        end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("value") * factor).cast("long") / 1000).cast("decimal(18,6)"))
        return events.filter(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").alias("start"), end.alias("end"))

    met = intervals.overlapping(lasting("view", 60_000), lasting("purchase", 6_000_000), ["user_id"])
    return met.select("event_id", "other_event_id", "user_id")


@REGISTRY.register(
    "price_rollup",
    """
    WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, l_returnflag AS flag, l_linestatus AS status, l_quantity, l_shipdate
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT priority, flag, status, grouping(priority) = 1 AS all_priority, grouping(flag) = 1 AS all_flag, grouping(status) = 1 AS all_status,
           sum(l_quantity) AS quantity, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM x GROUP BY ROLLUP (priority, flag, status)
    """,
)
def price_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, grouping.rolled_up(["priority", "flag", "status"]))


@REGISTRY.register(
    "price_cube",
    """
    WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, l_returnflag AS flag, l_linestatus AS status, l_quantity, l_shipdate
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT priority, flag, status, grouping(priority) = 1 AS all_priority, grouping(flag) = 1 AS all_flag, grouping(status) = 1 AS all_status,
           sum(l_quantity) AS quantity, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM x GROUP BY CUBE (priority, flag, status)
    """,
)
def price_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, grouping.cubed(["priority", "flag", "status"]))


@REGISTRY.register(
    "price_grouping_sets",
    """
    WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, l_returnflag AS flag, l_linestatus AS status, l_quantity, l_shipdate
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT priority, flag, status, grouping(priority) = 1 AS all_priority, grouping(flag) = 1 AS all_flag, grouping(status) = 1 AS all_status,
           sum(l_quantity) AS quantity, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM x GROUP BY GROUPING SETS ((priority), (flag, status), ())
    """,
)
def price_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, [["priority"], ["flag", "status"], []])


def _priced(spark: SparkSession, sf_dir: str, sets: list[list[str]]) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority")  # nulls of the data beside those of totals
    orders = table(spark, sf_dir, "orders").select("o_orderkey", priority)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_shipdate")
    measures = {"quantity": ("sum", "l_quantity"), "n": ("count", "*"), "first": ("min", "l_shipdate"), "last": ("max", "l_shipdate")}
    return grouping.totals(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ["priority", "flag", "status"], sets, measures)


@REGISTRY.register(
    "event_props",
    """
    WITH t AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN left(props, len(props) - 1) WHEN 1 THEN '{"k": "x"}' WHEN 2 THEN '{"j": 1}' WHEN 3 THEN NULL WHEN 4 THEN '{"k": null}'
                      WHEN 5 THEN '{"k": {"deep": ' || event_id || '}}' WHEN 6 THEN '{"k": "' || event_id || '", "tags": ["' || event_type || '", "u"]}' ELSE props END AS text FROM events),
    j AS (SELECT event_id, text, CASE WHEN text IS NOT NULL AND json_valid(text) THEN text::JSON END AS v FROM t)
    SELECT event_id, TRY_CAST(v ->> '$.k' AS BIGINT) AS k, v ->> '$.tags[0]' AS tag, TRY_CAST(v ->> '$.k.deep' AS BIGINT) AS deep,
           CASE WHEN text IS NULL THEN 'missing' WHEN v IS NULL THEN 'malformed' WHEN NOT json_exists(v, '$.k') THEN 'no $.k' WHEN json_type(v, '$.k') = 'NULL' THEN '$.k is null'
                WHEN TRY_CAST(v ->> '$.k' AS BIGINT) IS NULL THEN '$.k is no bigint' END AS reason FROM j
    """,
)
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' props, every tenth of them spoilt in each of several ways; each row stays, with what is wrong."""
    n, whole = F.col("event_id"), F.col("props")
    spoilt = {
        0: F.substring(whole, F.lit(1), F.length(whole) - 1), 1: F.lit('{"k": "x"}'), 2: F.lit('{"j": 1}'), 3: F.lit(None).cast("string"), 4: F.lit('{"k": null}'),
        5: F.concat(F.lit('{"k": {"deep": '), n, F.lit("}}")), 6: F.concat(F.lit('{"k": "'), n, F.lit('", "tags": ["'), "event_type", F.lit('", "u"]}')),
    }
    text = whole
    for k, other in spoilt.items():
        text = F.when(n % 10 == k, other).otherwise(text)
    fields = {"k": ("$.k", "bigint"), "tag": ("$.tags[0]", "string"), "deep": ("$.k.deep", "bigint")}
    return semistructured.parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", fields, ("k",)).drop("text")


@REGISTRY.register(
    "merged_sketches",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS users_inside, true AS median_inside, true AS high_inside FROM events GROUP BY event_type",
)
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day and type, stored, then merged to types; whether their estimates are inside the stated bounds of exact results."""
    events = table(spark, sf_dir, "events")
    path = f"{sinks.shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.sketched(events, ["event_type", F.to_date("ts").alias("day")], "user_id", "value").write.parquet(path)
    found = sketches.estimated(sketches.merged(spark.read.parquet(path), ["event_type"]), [0.5, 0.95]).drop("distinct_sketch", "value_sketch")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    both = events.select("event_type", "value").join(F.broadcast(found), "event_type")  # a row for each of few types
    ranks = both.groupBy("event_type").agg(*[x for q in ("quantile_0", "quantile_1") for x in _ranks(q)])
    x = found.join(exact, "event_type").join(ranks, "event_type")
    near = lambda q, at: (F.col(f"below_{q}") <= at + sketches.RANK_ERROR) & (F.col(f"upto_{q}") >= at - sketches.RANK_ERROR)
    return x.select(
        "event_type", "n", "n_users", (F.abs(F.col("n_distinct") - F.col("n_users")) <= F.ceil(F.col("n_users") * sketches.DISTINCT_ERROR)).alias("users_inside"),
        near("quantile_0", 0.5).alias("median_inside"), near("quantile_1", 0.95).alias("high_inside"),
    )


def _ranks(q: str) -> list:
    """Shares of rows below a quantile, and up to it."""
    share = lambda hit, name: (F.count_if(hit) / F.count("value")).alias(f"{name}_{q}")
    return [share(F.col("value") < F.col(q), "below"), share(F.col("value") <= F.col(q), "upto")]


@REGISTRY.register(
    "event_streaks",
    """
    WITH x AS (SELECT *, ts::DATE AS day, row_number() OVER u - row_number() OVER v AS island FROM events
               WINDOW u AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id), v AS (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id))
    SELECT event_type AS value, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM x GROUP BY user_id, day, event_type, island
    """,
)
def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type in each user's day."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    return table_functions.streaks(events, ["user_id", "day"], ["ts", "event_id"], "event_type", "ts")


@REGISTRY.register(
    "shared_copies",
    """
    SELECT l_returnflag AS kind, NULLIF(l_linenumber, 3) AS number FROM lineitem WHERE l_orderkey % 2 = 0
    INTERSECT ALL SELECT l_returnflag, NULLIF(l_linenumber, 3) FROM lineitem WHERE l_orderkey % 3 = 0
    """,
)
def shared_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.multiset(*_halves(spark, sf_dir), "both")


@REGISTRY.register(
    "surplus_copies",
    """
    SELECT l_returnflag AS kind, NULLIF(l_linenumber, 3) AS number FROM lineitem WHERE l_orderkey % 2 = 0
    EXCEPT ALL SELECT l_returnflag, NULLIF(l_linenumber, 3) FROM lineitem WHERE l_orderkey % 3 = 0
    """,
)
def surplus_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.multiset(*_halves(spark, sf_dir), "beyond")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    columns = [F.nullif(F.col("l_linenumber"), F.lit(3)).alias("number"), F.col("l_returnflag").alias("kind")]
    return lines.filter("l_orderkey % 2 = 0").select(*columns[::-1]), lines.filter("l_orderkey % 3 = 0").select(*columns)


@REGISTRY.register(
    "top_orders",
    "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC) AS rank FROM orders QUALIFY rank <= 2",
)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest orders in steps of 10,000, ties included."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", -4).alias("step"))
    return ranking.first_of(orders, ["o_custkey"], [F.desc("step")], 2, ties=True).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@REGISTRY.register(
    "last_day_sums",
    """
    SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total, max(value) OVER w AS most FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
    """,
)
def last_day_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event what its user did in the day up to it."""
    sums = {"n": F.count("*"), "total": F.sum("value"), "most": F.max("value")}
    x = intervals.within(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", 86_400, sums)
    return x.select("event_id", "n", F.round("total", 2).alias("total"), "most")


def _by_text(name: str, text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        surface(spark, sf_dir)
        return spark.sql(text)

    REGISTRY.register(f"sql_{name}", catalog.REGISTRY.oracles[name])(query)


for _name, _text in SQL_QUERIES.items():
    _by_text(_name, _text)
