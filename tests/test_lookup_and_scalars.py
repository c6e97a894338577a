import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from lakeshore.functions import scalars as S
from lakeshore.functions.classes import class_names
from lakeshore.operators import lookup
from lakeshore.sources import literals, sinks
from lakeshore.streaming.store import ticker


def value(spark, column, row="1 AS one"):
    return spark.sql(f"SELECT {row}").select(column.alias("v")).first().v


@pytest.mark.parametrize("few", [10_000, 0])
def test_section_of_largest_index(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "BROADCAST_SECTIONS", few)
    sections = spark.createDataFrame([(0, "a", 0), (1, "b", 900), (2, "missing", None), (3, "c", 500), (4, "d", 2000)], "idx int, id string, offset_top int")
    tops = spark.createDataFrame([(k, k * 100 - 400) for k in range(30)] + [(99, None)], "k int, y int")
    got = {r.k: r.section for r in lookup.last_section(tops, sections, "k", "y").collect()}
    for k in range(30):
        at = k * 100 - 200
        fits = [i for i, t in (("a", 0), ("b", 900), ("c", 500), ("d", 2000)) if t <= at]
        assert got[k] == (fits[-1] if fits else None)
    assert got[99] is None


def test_many_sections_and_one_hot_position(spark, monkeypatch):
    sections = spark.range(10_001).selectExpr("int(id) AS idx", "concat('s', id) AS id", "int(id * 7919 % 10007) AS offset_top")
    tops = spark.range(40_000).selectExpr("int(id) AS k", "CASE WHEN id % 10 > 0 THEN 77 WHEN id % 70 = 0 THEN NULL ELSE int(id % 9000) END AS y")
    got = lookup.last_section(tops, sections, "k", "y")
    monkeypatch.setattr(lookup, "BROADCAST_SECTIONS", 20_000)
    assert got.exceptAll(lookup.last_section(tops, sections, "k", "y")).count() == 0 and got.count() == 40_000
    assert got.filter("section is null").count() == tops.filter("y is null").count()


def test_no_match_carries_the_last(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, "a"), ("u", 3, None), ("v", 1, None)], "u string, t int, section string")
    got = lookup.carried_forward(df, "u", ["t"], "section", lookup.FIRST_SECTION).orderBy("u", "t").collect()
    assert [r.section for r in got] == ["meet-us", "a", "a", "meet-us"]


def test_items_and_cycles(spark):
    assert [value(spark, lookup.cycled(F.lit(k), 3)) for k in (0, 2, 3, -1)] == [0, 2, 0, 2]
    assert value(spark, lookup.item(F.array(F.lit("a")), F.lit(0))) == "a"
    assert value(spark, lookup.item(F.array(F.lit("a")), F.lit(5))) is None
    assert value(spark, lookup.scroll_target(F.lit(100))) == 20
    assert literals.ordered(spark).count() == 7
    assert [tuple(r) for r in ticker(spark.range(4).withColumnRenamed("id", "value"), {"main": 6, "left": 3}).collect()] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 0)]


def test_falsy_and_null_fallbacks(spark):
    null = F.lit(None).cast("string")
    assert value(spark, S.first_truthy(F.lit(""), null, F.lit("value"))) == "value"
    assert value(spark, S.first_known(F.lit(""), F.lit("value"))) == ""
    assert value(spark, S.item_key(null, F.lit(""), null)) == "value"
    for x, want in ((0.0, 100), (float("nan"), 100), (None, 100), (30.0, 70)):
        assert value(spark, S.remaining(F.lit(x).cast("double"))) == want
    assert value(spark, S.first_truthy(F.lit(False), F.lit(True), kind="boolean")) is True


def test_breakpoints_and_routes(spark):
    none = F.lit(None).cast("int")
    assert [value(spark, S.is_mobile(w)) for w in (F.lit(767), F.lit(768), none)] == [True, False, False]
    assert [value(spark, S.at_least(w, F.lit("b"), F.lit("a"))) for w in (F.lit(1023), F.lit(1024), none)] == ["a", "b", "a"]
    assert [value(spark, S.routed(F.lit(p), {"/": "home"}, "404")) for p in ("/", "/x", None)] == ["home", "404", "404"]
    assert value(spark, S.routed(F.lit("/"), {}, "404")) == "404"
    assert value(spark, S.when_equal(F.lit(None).cast("string"), "a", "y", "n")) == "n"


@pytest.mark.parametrize(
    "given, merged",
    [
        ("p-2 flex|hover:p-1 p-4  flex", "hover:p-1 p-4 flex"),
        ("bg-red-500 bg-blue-600", "bg-blue-600"),
        ("px-2 p-4", "p-4"),
        ("p-4 px-2", "p-4 px-2"),
        ("flex hidden", "hidden"),
        ("text-sm text-center", "text-sm text-center"),
        ("text-sm text-primary text-lg", "text-primary text-lg"),
        ("my-own other my-own", "other my-own"),  # my- is a margin
        ("card card", "card card"),
        ("md:hover:px-1 hover:md:px-2 md:hover:p-3", "md:hover:p-3"),  # variants in any order
        ("hover:focus:p-1 focus:hover:p-2", "focus:hover:p-2"),
        ("[&>p]:hover:p-1 hover:[&>p]:p-2", "[&>p]:hover:p-1 hover:[&>p]:p-2"),  # but not across those in brackets
        ("a:b:[x]:c:d:p-1 b:a:[x]:d:c:p-2", "b:a:[x]:d:c:p-2"),
        ("brightness-50 brightness-100", "brightness-100"),
        ("overscroll-x-auto overscroll-auto overscroll-contain", "overscroll-contain"),
        ("divide-x-2 divide-x-4 divide-red-500 divide-dashed", "divide-x-4 divide-red-500 divide-dashed"),
        ("accent-red-500 accent-blue-500", "accent-blue-500"),
        ("mix-blend-multiply mix-blend-screen", "mix-blend-screen"),
        ("will-change-auto will-change-scroll", "will-change-scroll"),
        ("lining-nums tabular-nums ordinal normal-nums", "normal-nums"),
        ("lining-nums normal-nums ordinal", "lining-nums ordinal"),
        ("lining-nums tabular-nums oldstyle-nums", "tabular-nums oldstyle-nums"),
        ("scroll-px-2 scroll-p-4 scroll-auto scroll-smooth", "scroll-p-4 scroll-smooth"),
        ("touch-pan-x touch-pan-y touch-none", "touch-none"),
        ("backdrop-blur-sm blur-sm backdrop-blur", "blur-sm backdrop-blur"),
        ("decoration-2 decoration-wavy decoration-red-500 decoration-4", "decoration-wavy decoration-red-500 decoration-4"),
        ("snap-start snap-x snap-mandatory snap-both snap-end", "snap-mandatory snap-both snap-end"),
        ("list-disc list-inside list-decimal", "list-inside list-decimal"),
        ("columns-2 columns-3 table-auto table-fixed table", "columns-3 table-fixed table"),
        ("from-10% from-red-500 from-20%", "from-red-500 from-20%"),
        ("-mt-2 mt-4 !mt-1", "mt-4 !mt-1"),
        ("w-4 h-4 size-6 h-2", "size-6 h-2"),
        ("border border-t-2 border-input border-0", "border-input border-0"),
        ("[&>svg]:size-4 data-[state=open]:flex [&>svg]:size-3 data-[state=open]:hidden", "[&>svg]:size-3 data-[state=open]:hidden"),
        ("leading-6 text-base", "text-base"),
        ("", ""),
    ],
)
def test_class_names(spark, given, merged):
    parts = F.concat(F.split(F.lit(given), r"\|"), F.array(F.lit(None).cast("string"), F.lit("")))
    assert value(spark, class_names(parts)) == merged


CONFIG = """map('a', named_struct('label', 'A', 'color', 'red', 'theme', CAST(NULL AS map<string,string>)),
                'b', named_struct('label', '', 'color', '', 'theme', map('dark', 'navy')),
                'c', named_struct('label', 'C', 'color', CAST(NULL AS string), 'theme', CAST(NULL AS map<string,string>)),
                'n', CAST(NULL AS struct<label:string,color:string,theme:map<string,string>>)) AS config"""


def test_style_text(spark):
    light = "\n [data-chart=x] {\n  --color-a: red;\n\n}\n"
    dark = "\n.dark [data-chart=x] {\n  --color-a: red;\n  --color-b: navy;\n}\n"
    assert value(spark, S.style_text(F.col("config"), F.lit("x")), CONFIG) == light + "\n" + dark
    assert value(spark, S.style_text(F.map_filter("config", lambda k, _: k == "c"), F.lit("x")), CONFIG) is None


def test_payload_lookup(spark):
    text = lambda **kw: F.create_map(*[F.lit(x) for k in kw.items() for x in k]) if kw else F.create_map().cast("map<string,string>")
    label = lambda own, nested, key: value(spark, S.payload_config(F.col("config"), own, nested, F.lit(key))["label"], CONFIG)
    assert label(text(k="a"), text(k="c"), "k") == "A"
    assert label(text(), text(k="c"), "k") == "C"
    assert label(text(k="zz"), text(), "a") == "A"
    assert label(text(a="n"), text(), "a") is None  # present, though null
    assert value(spark, S.own_label(F.col("config"), F.lit("b")), CONFIG) == "b"
    assert value(spark, S.own_label(F.col("config"), F.lit("a")), CONFIG) == "A"


def test_numbers(spark):
    want = {1234567.8915: "1,234,567.892", 0.5: "0.5", 1000.0: "1,000", -2.5: "-2.5", 0.0: None, float("nan"): None}
    assert {x: value(spark, S.grouped_number(F.lit(x))) for x in list(want)[:5]} == {k: v for k, v in list(want.items())[:5]}
    assert value(spark, S.grouped_number(F.lit(float("nan")))) is None
    widths = [{r.id: r.w for r in spark.range(2000).repartition(n).select("id", S.random_width(F.col("id"), 3).alias("w")).collect()} for n in (1, 8)]
    assert widths[0] == widths[1]  # an instance keeps its width
    assert set(widths[0].values()) == set(range(50, 90))
    assert value(spark, S.random_width(F.lit(None).cast("int"))) == value(spark, S.random_width(F.lit("")))
    assert len({value(spark, S.random_width(F.lit(5), seed)) for seed in range(9)}) > 3


def test_elements(spark):
    text = lambda x: F.lit(x).cast("string")
    parts = lambda *xs: [tuple(p) for p in value(spark, S.element(F.lit("k"), *map(text, xs))).parts]
    assert parts("t", "d", "a") == [("title", "t"), ("description", "d"), ("action", "a"), ("close", "")]
    assert parts("", None, "") == [("action", ""), ("close", "")] and parts(None, "d", None) == [("description", "d"), ("close", "")]


def test_collections(spark):
    items = F.array(F.lit("a"), F.lit(""), F.lit(None).cast("string"))
    empty = F.array().cast("array<string>")
    assert value(spark, S.first_item(items)) == "a" and value(spark, S.first_item(empty)) is None
    assert [value(spark, f(x)) for f in (S.is_empty, S.is_single) for x in (items, empty, F.array(F.lit(1)), F.lit(None).cast("array<int>"))] == [False, True, False, True, False, False, True, False]
    assert value(spark, S.without_falsy(items)) == ["a"]
    assert value(spark, S.without(F.lit(":r1:"))) == "r1"
    assert value(spark, S.overridden(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")))) == {"a": "1", "b": "3", "c": "4"}
    assert value(spark, S.overridden(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"))) == {"a": "1"}
    assert value(spark, S.as_record(F.lit("tip"))).children == "tip"
    table = F.create_map(F.lit("default"), F.lit("h-8"), F.lit("sm"), F.lit("h-7"))
    assert [value(spark, S.variant(table, F.lit(v).cast("string"))) for v in (None, "sm", "zz")] == ["h-8", "h-7", None]


def test_flags_and_events(spark):
    none = F.lit(None).cast("boolean")
    assert [value(spark, S.open_state(x)) for x in (F.lit(True), F.lit(False), none)] == ["expanded", "collapsed", "collapsed"]
    assert [value(spark, S.is_shortcut(F.lit(k), m, c)) for k, m, c in (("b", F.lit(True), none), ("b", none, F.lit(True)), ("b", none, none), ("x", F.lit(True), none))] == [True, True, False, False]
    assert [value(spark, S.arrow_step(F.lit(k))) for k in ("ArrowLeft", "ArrowRight", "a")] == [-1, 1, None]
    error = F.struct(F.lit("bad").alias("message"))
    gone = F.when(F.lit(False), error)
    assert value(spark, S.message(error, F.lit("child"))) == "bad" and value(spark, S.message(gone, F.lit("child"))) == "child" and value(spark, S.message(gone, F.lit(""))) is None
    assert value(spark, S.derived_id(F.lit("f1"), "-form-item")) == "f1-form-item"
    assert value(spark, S.toggled(F.lit(True))) is False


def test_sinks(spark, caplog):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", "true", at), ("s", "false", at + dt.timedelta(hours=1))], "k string, v string, at timestamp")
    (row,) = sinks.stored(df, "k", "v", "at").collect()
    assert row.value == "false" and row.expires == at + dt.timedelta(days=7, hours=1)
    with caplog.at_level(logging.ERROR):
        seen = []
        sinks.fanned_out([sinks.unmatched_logged(), lambda b, n: seen.append(b.count())])(spark.createDataFrame([("/x",), ("/x",)], "path string"), 3)
    assert seen == [2] and "no route for /x (2 times, batch 3)" in caplog.text


def test_every_unmatched_path_is_kept(spark, caplog, tmp_path):
    paths = [f"/p{k}" for k in range(50) for _ in range(k + 1)] + [None]
    log = sinks.unmatched_logged(folder=f"file://{tmp_path}/unmatched")
    for _ in range(2):  # a repeated batch replaces its own counts
        log(spark.createDataFrame([(p,) for p in paths], "path string"), 7)
    got = spark.read.parquet(f"file://{tmp_path}/unmatched/batch=7").collect()
    assert {r.path: r["count"] for r in got} == {None: 1} | {f"/p{k}": k + 1 for k in range(50)} and len(got) == 51
    assert "no route for /p49 (50 times, batch 7)" in caplog.text and "31 more paths (batch 7)" in caplog.text
    sinks.unmatched_logged()(spark.createDataFrame([], "path string"), 1)
