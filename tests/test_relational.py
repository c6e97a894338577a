"""Intervals, groupings, JSON, sketches, table functions, counted set operations, frames by time and SQL: odd rows, ties, empty tables, plans."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeshore.functions import semistructured, table_functions
from lakeshore.operators import grouping, intervals, ranking, sketches
from lakeshore.plans import catalog, relational, sql

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SPAN = "id int, k string, start long, end long"


def spans(rng, n, first=0):
    out = []
    for i in range(first, first + n):
        a = rng.choice([rng.randrange(-2000, 2000), rng.randrange(20)])
        out.append((i, rng.choice(["x", "y", None]), a, a + rng.choice([0, 0, 1, 3, 64, 500, 10_000, -1])))
    return [*out, (900 + first, "x", None, 5), (901 + first, "x", 5, None), (902 + first, "x", 7, 7), (902 + first, "x", 7, 7)]


@pytest.mark.parametrize("on", [(), ("k",)])
def test_overlaps_like_all_pairs(spark, on):
    rng = random.Random(len(on))
    a, b = spans(rng, 120), spans(rng, 120, 2000)
    got = intervals.overlapping(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), on)
    assert got.columns == ["id", "k", "start", "end", "other_id", "other_k", "other_start", "other_end"]
    known = lambda s: None not in s[2:] and s[2] <= s[3]
    want = [x + y for x in a for y in b if known(x) and known(y) and x[2] <= y[3] and y[2] <= x[3] and (not on or (x[1] is not None and x[1] == y[1]))]
    assert rows(got) == sorted(want, key=str) and len(want) > 300
    assert not re.search("NestedLoop|Cartesian", plan(got))


def test_long_intervals_do_not_multiply_rows(spark):
    short = spark.range(5000).selectExpr("int(id) id", "'x' k", "id * 10 start", "id * 10 + 5 end")
    long = spark.createDataFrame([(1, "x", 0, 1 << 40), (2, "x", 3, 1 << 50), (3, "x", -(1 << 55), 1 << 55)], SPAN)
    assert intervals.overlapping(short, long).count() == 15_000
    dealt = intervals._dealt(short.withColumns({"_from": F.col("start"), "_to": F.col("end"), "_own": F.lit(3)}), [3, 41, 51, 57])
    assert dealt.count() <= 5000 * (2 + 2 * 3)


def test_times_and_empty_sides(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, t + dt.timedelta(hours=1))], "id int, start timestamp_ntz, end timestamp_ntz")
    assert intervals.overlapping(df, df).count() == 1 and intervals.overlapping(df, df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="start is a double"):
        intervals.overlapping(spark.createDataFrame([(1.0, 2.0)], "start double, end double"), df)


@pytest.mark.parametrize("bucket", [None, 5000])
def test_frames_by_time(spark, bucket):
    rng = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    data = [(i, rng.choice(["u", "v", None]), t + dt.timedelta(seconds=rng.choice([rng.randrange(20_000), 3600, 7200])), rng.choice([None, rng.randrange(9)])) for i in range(300)]
    data += [(400, "u", None, 1), (401, "u", None, 2), (402, None, None, 3)]
    df = spark.createDataFrame(data, "id int, user string, at timestamp, value int")
    got = intervals.within(df, "user", "at", 3600, {"n": F.count("*"), "total": F.sum("value")}, bucket)

    def frame(r):
        own = [x for x in data if x[1] == r[1] and ((x[2] is None) == (r[2] is None)) and (r[2] is None or 0 <= (r[2] - x[2]).total_seconds() <= 3600)]
        values = [x[3] for x in own if x[3] is not None]
        return (*r, len(own), sum(values) if values else None)

    assert rows(got) == sorted((frame(r) for r in data), key=str)
    assert intervals.within(df.limit(0), "user", "at", 60, {"n": F.count("*")}).count() == 0


def test_totals_tell_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "p", 2), (None, "p", 4), (None, None, 8), ("a", "p", None)], "x string, y string, v int")
    measures = {"n": ("count", "*"), "total": ("sum", "v"), "most": ("max", "v")}
    got = rows(grouping.totals(df, ["x", "y"], grouping.rolled_up(["x", "y"]), measures))
    want = [("a", None, False, False, 1, 1, 1), ("a", "p", False, False, 2, 2, 2), (None, "p", False, False, 1, 4, 4), (None, None, False, False, 1, 8, 8),
            ("a", None, False, True, 3, 3, 2), (None, None, False, True, 2, 12, 8), (None, None, True, True, 5, 15, 8)]
    assert got == sorted(want, key=str)
    assert grouping.cubed(["x", "y"]) == [["x", "y"], ["x"], ["y"], []]
    assert len(rows(grouping.totals(df, ["x", "y"], grouping.cubed(["x", "y"]), measures))) == 9
    assert rows(grouping.totals(df.limit(0), ["x", "y"], [["x"], []], measures)) == []
    # rows are combined by all keys before they are expanded to groupings
    text = plan(grouping.totals(df, ["x", "y"], grouping.cubed(["x", "y"]), measures))
    assert text.index("Expand") < text.rindex("HashAggregate(keys=[x") and text.count("partial_count") == 1


def test_copies_are_counted(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 2 + [(None, None)] * 2, "k int, v string")
    b = spark.createDataFrame([(None, 1)] * 2 + [("x", 2)] * 5 + [(None, None)], "v string, k int")
    assert rows(grouping.multiset(a, b, "both")) == sorted([(1, None)] * 2 + [(2, "x")] * 2 + [(None, None)], key=str)
    assert rows(grouping.multiset(a, b, "beyond")) == sorted([(1, None), (None, None)], key=str)
    assert grouping.multiset(a, b.limit(0), "both").count() == 0 and grouping.multiset(a, b.limit(0), "beyond").count() == 7
    with pytest.raises(ValueError, match="both or beyond"):
        grouping.multiset(a, b, "union")


def test_spoilt_json_keeps_its_rows(spark):
    texts = [None, "", "{", '{"k": 1}', '{"k": "7", "t": ["a"]}', '{"k": [1]}', '{"k": null}', "[]", "3", '{"k": 1.0}', '{"K": 1}', '{"k": 99999999999999999999}']
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, text string, _value string")
    got = {r.id: (r.k, r.t, r.reason) for r in semistructured.parsed(df, "text", {"k": ("$.k", "bigint"), "t": ("$.t[0]", "string")}, ("k",)).collect()}
    assert got == {
        0: (None, None, "missing"), 1: (None, None, "malformed"), 2: (None, None, "malformed"), 3: (1, None, None), 4: (7, "a", None), 5: (None, None, "$.k is no bigint"),
        6: (None, None, "$.k is null"), 7: (None, None, "no $.k"), 8: (None, None, "no $.k"), 9: (1, None, None), 10: (None, None, "no $.k"), 11: (None, None, "$.k is no bigint"),
    }
    all_ = semistructured.parsed(df.select("id", "text"), "text", {"k": ("$.k", "bigint"), "t": ("$.t[0]", "string")})
    assert {r.id: r.reason for r in all_.collect()}[3] == "no $.t[0]" and all_.filter("id < 0").count() == 0


def test_sketches_of_parts_are_those_of_the_whole(spark):
    df = spark.range(60_000).selectExpr("id % 7 part", "CASE WHEN id % 3 = 0 THEN id % 5000 END who", "double(id * 7919 % 60000) v").unionByName(spark.createDataFrame([(9, None, None)], "part long, who long, v double"))
    parts = sketches.sketched(df, ["part"], "who", "v")
    whole = sketches.estimated(sketches.merged(parts, []), [0.0, 0.5, 0.99, 1.0]).first()
    assert whole.n == 60_001 and abs(whole.n_distinct - 5000) <= 5000 * sketches.DISTINCT_ERROR
    assert (whole.quantile_0, whole.quantile_3) == (0.0, 59_999.0)
    for q, got in ((0.5, whole.quantile_1), (0.99, whole.quantile_2)):
        assert abs(got / 60_000 - q) <= sketches.RANK_ERROR
    none = sketches.estimated(parts.filter("part = 9"), [0.5]).first()
    assert (none.n, none.n_distinct, none.quantile_0) == (1, 0, None)
    assert sketches.sketched(df.limit(0), ["part"], "who", "v").count() == 0


def test_streaks(spark):
    data = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, None), ("u", 5, "a"), (None, 1, "b"), ("v", 1, "a"), ("v", 1, "a")]
    df = spark.createDataFrame(data, "who string, t int, kind string")
    want = sorted([("a", 1, 2, 2), (None, 3, 4, 2), ("a", 5, 5, 1), ("b", 1, 1, 1), ("a", 1, 1, 2)], key=str)
    assert rows(table_functions.streaks(df, ["who"], ["t"], "kind", "t")) == want
    table_functions.registered(spark)
    df.createOrReplaceTempView("seen")
    assert rows(spark.sql("SELECT * FROM streaks(TABLE(seen) PARTITION BY who ORDER BY (t), 'kind', 't')")) == want
    assert rows(table_functions.streaks(df.limit(0), ["who"], ["t"], "kind", "t")) == []
    with pytest.raises(Exception, match="finds no column other"):
        table_functions.streaks(df, ["who"], ["t"], "other", "t").count()


@pytest.mark.parametrize("name", sql.SQL_QUERIES)
def test_text_plans_like_the_operators(spark, name):
    """A query by text has the operators of the same query by DataFrames: SQL functions leave nothing of their own in the plan."""
    by_text = relational.REGISTRY.queries[f"sql_{name}"](spark, SF)
    by_frames = catalog.REGISTRY.queries[name](spark, SF)
    steps = lambda df: sorted(re.findall(r"(\w*(?:Scan|Exchange|Join|Aggregate|Filter|EvalPython\w*|Sort))\b", plan(df)))
    assert steps(by_text) == steps(by_frames) and by_text.schema.simpleString() == by_frames.schema.simpleString()


def test_first_rows_of_groups(spark):
    data = [(1, "a", 5), (2, "a", 5), (3, "a", 9), (4, "a", 1), (5, None, 2), (6, None, None), (7, "b", 3)]
    df = spark.createDataFrame(data, "id int, k string, v int")
    order = [F.desc_nulls_last("v")]
    assert rows(ranking.first_of(df, ["k"], [*order, F.asc("id")], 2)) == sorted([(3, "a", 9, 1), (1, "a", 5, 2), (5, None, 2, 1), (6, None, None, 2), (7, "b", 3, 1)], key=str)
    tied = ranking.first_of(df, ["k"], order, 2, ties=True)
    assert rows(tied) == sorted([(3, "a", 9, 1), (1, "a", 5, 2), (2, "a", 5, 2), (5, None, 2, 1), (6, None, None, 2), (7, "b", 3, 1)], key=str)
    assert ranking.first_of(df.limit(0), ["k"], order, 2).count() == 0
    text = plan(ranking.first_of(spark.range(100).selectExpr("id % 3 k", "id v"), ["k"], [F.desc("v")], 2))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")  # limited below the shuffle too
