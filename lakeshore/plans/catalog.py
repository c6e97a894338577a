"""The queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions import scalars as S
from lakeshore.functions.classes import class_names
from lakeshore.operators import keyed_state, lookup
from lakeshore.registry import Registry
from lakeshore.sources import literals, sinks
from lakeshore.sources.tables import table
from lakeshore.streaming import store

REGISTRY = Registry()


@REGISTRY.register(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus,
           round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           count(*) AS n_lines
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.count("*").alias("n_lines"),
    )


@REGISTRY.register("newest_n", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_state.newest(table(spark, sf_dir, "events"), "event_id").select("event_id", "user_id", "event_type")


@REGISTRY.register(
    "keyed_update",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.source END AS source,
           CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN NULL ELSE d.lang END AS lang
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
)
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    toxic = F.col("toxic") == 1
    updates = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality")).alias("source"), F.lit(None).cast("string").alias("lang"),
        F.when(toxic, F.array(F.lit("source"), F.lit("lang"))).otherwise(F.array(F.lit("source"))).alias("present"),
    )
    return keyed_state.updated(docs, updates, "doc_id", ["source", "lang"], "present")


@REGISTRY.register("conditional_close", "SELECT o_orderkey, o_orderkey <> 7 AS one_open, false AS all_open FROM orders")
def conditional_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(True).alias("one_open"), F.lit(True).alias("all_open"))
    return keyed_state.closed(keyed_state.closed(orders, "o_orderkey", 7, "one_open"), "o_orderkey", None, "all_open")


@REGISTRY.register("keyed_delete", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_state.deleted_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@REGISTRY.register("keyed_delete_one", "SELECT o_orderkey, count(*) OVER () AS n_left FROM orders WHERE o_orderkey <> 7")
def keyed_delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey is not null")  # as in SQL
    left = keyed_state.deleted(orders, "o_orderkey", 7)
    return left.crossJoin(F.broadcast(left.agg(F.count("*").alias("n_left"))))  # one row: a window over all would be one task


@REGISTRY.register("keyed_delete_all", "SELECT o_orderkey FROM orders WHERE false")
def keyed_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_state.deleted(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", None)


@REGISTRY.register(
    "first_request_expiry",
    "SELECT user_id, min(ts) AS requested, min(ts) + INTERVAL 1000 SECONDS AS expires FROM events WHERE event_type = 'error' GROUP BY user_id",
)
def first_request_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_state.first_expiry(table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", "ts")


@REGISTRY.register("dense_string_id", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey))::VARCHAR AS id FROM customer")
def dense_string_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return keyed_state.dense_ids(customers, ["c_custkey"], F.floor(F.col("c_custkey") / 65536))


@REGISTRY.register(
    "action_dispatch",
    """
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'update' WHEN 'error' THEN 'dismiss' WHEN 'purchase' THEN 'remove'
           ELSE 'none' END AS op FROM events
    """,
)
def action_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {"signup": F.lit("add"), "click": F.lit("update"), "error": F.lit("dismiss"), "purchase": F.lit("remove")}
    return table(spark, sf_dir, "events").select("event_id", keyed_state.dispatched(F.col("event_type"), ops, F.lit("none")).alias("op"))


@REGISTRY.register(
    "change_log_replay",
    """
    WITH a AS (SELECT user_id AS store, event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'update' WHEN 'error' THEN 'dismiss'
                      WHEN 'purchase' THEN 'remove' END AS type, value FROM events WHERE event_type <> 'view'),
    l AS (SELECT store, max(seq) AS seq FROM a WHERE type = 'add' GROUP BY store),
    x AS (SELECT a.* FROM a JOIN l ON l.store = a.store AND a.seq >= l.seq)
    SELECT store, '1' AS toast_id, arg_max(round(value, 2)::VARCHAR, seq) FILTER (type IN ('add', 'update')) AS title,
           arg_max(type <> 'dismiss', seq) FILTER (type IN ('add', 'dismiss')) AS open
    FROM x GROUP BY store HAVING count(*) FILTER (type = 'remove') = 0
    """,
)
def change_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = {"signup": F.lit("add"), "click": F.lit("update"), "error": F.lit("dismiss"), "purchase": F.lit("remove")}
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("store"), F.col("event_id").alias("seq"), keyed_state.dispatched(F.col("event_type"), ops).alias("type"), F.lit("1").alias("toast_id"),
        F.round("value", 2).cast("string").alias("title"), F.lit(None).cast("boolean").alias("open"), F.array(F.lit("title")).alias("present"),
    )
    return keyed_state.replayed(log.filter("type is not null"), ["title", "open"])


@REGISTRY.register(
    "handle_replay",
    """
    WITH s AS (SELECT event_id, user_id, (row_number() OVER (ORDER BY event_id))::VARCHAR AS id FROM events WHERE event_type = 'signup'),
    l AS (SELECT user_id AS store, max(event_id) AS seq, arg_max(id, event_id) AS toast_id FROM s GROUP BY user_id)
    SELECT store, toast_id, arg_max(round(value, 2)::VARCHAR, event_id) FILTER (event_type IN ('signup', 'click')) AS title, count(*) FILTER (event_type = 'error') = 0 AS open
    FROM l JOIN events ON user_id = store AND event_id >= seq GROUP BY store, toast_id
    """,
)
def handle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records raised by signups; clicks update and errors dismiss through the handle that the last signup returned."""
    kind = F.col("event_type")
    ops = {"signup": F.lit("add"), "click": F.lit("update"), "error": F.lit("dismiss")}
    requests = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value").filter(kind.isin(*ops))
    through = keyed_state.handled(requests, "user_id", "event_id", kind == "signup", F.floor(F.col("event_id") / 65536), F.to_date("ts"))
    log = through.filter("toast_id is not null").select(
        F.col("user_id").alias("store"), F.col("event_id").alias("seq"), keyed_state.dispatched(kind, ops).alias("type"), "toast_id",
        F.round("value", 2).cast("string").alias("title"), F.lit(None).cast("boolean").alias("open"), F.array(F.lit("title")).alias("present"),
    )
    return keyed_state.replayed(log, ["title", "open"])


@REGISTRY.register(
    "rendered_records",
    """
    SELECT conv_id || '-' || turn AS key, CASE WHEN role <> 'user' THEN 'title=' || role || '|' ELSE '' END || CASE WHEN len(text) > 40 THEN 'description=' || left(text, 40) || '|' ELSE '' END
           || CASE WHEN turn % 3 > 0 THEN 'action=' || CASE WHEN turn % 3 = 1 THEN 'undo' ELSE '' END || '|' ELSE '' END || 'close=' AS parts FROM conversations
    """,
)
def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    description = F.when(F.char_length("text") > 40, F.substring("text", F.lit(1), F.lit(40))).otherwise(F.lit(""))
    action = F.when(F.col("turn") % 3 == 1, F.lit("undo")).when(F.col("turn") % 3 == 2, F.lit(""))
    shown = S.element(F.concat_ws("-", "conv_id", "turn"), title, description, action)
    x = table(spark, sf_dir, "conversations").select(shown.alias("shown"))
    return x.select("shown.key", F.array_join(F.transform("shown.parts", lambda p: F.concat_ws("=", p["part"], p["text"])), "|").alias("parts"))


BANDS = [(0, "tiny", 210), (1, "small", 215), (2, "gone", None), (3, "middle", 225), (4, "low", 212), (5, "large", 240)]


@REGISTRY.register(
    "section_lookup",
    """
    WITH b(idx, id, top) AS (VALUES (0, 'tiny', 210), (1, 'small', 215), (2, 'gone', NULL), (3, 'middle', 225), (4, 'low', 212), (5, 'large', 240))
    SELECT p_partkey, arg_max(id, idx) AS section FROM part LEFT JOIN b ON b.top <= p_size + 200 GROUP BY p_partkey
    """,
)
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "idx int, id string, offset_top int")
    return lookup.last_section(table(spark, sf_dir, "part"), bands, "p_partkey", "p_size")


@REGISTRY.register(
    "carry_forward",
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events
    """,
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return lookup.carried_forward(events, "user_id", ["ts", "event_id"], "last_purchase", bucket=F.to_date("ts")).select("event_id", "last_purchase")


@REGISTRY.register("nullable_lookup", "SELECT d.doc_id, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def nullable_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.existing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")


@REGISTRY.register("scroll_target", "SELECT p_partkey, p_size - 80 AS target FROM part")
def scroll_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lookup.scroll_target(F.col("p_size")).alias("target"))


@REGISTRY.register("active_style", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'muted' END AS style FROM orders")
def active_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.when_equal(F.col("o_orderstatus"), "O", "active", "muted").alias("style"))


@REGISTRY.register("cycling_counter", "SELECT event_id, event_id % 3 AS slide, ['a', 'b', 'c'][event_id % 3 + 1] AS image FROM events")
def cycling_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    slide = lookup.cycled(F.col("event_id"), 3)
    return table(spark, sf_dir, "events").select("event_id", slide.alias("slide"), lookup.item(F.array(*map(F.lit, "abc")), slide.cast("int")).alias("image"))


@REGISTRY.register(
    "breakpoint_flag",
    "SELECT doc_id, coalesce(n_chars < 768, false) AS mobile, CASE WHEN n_chars >= 1024 THEN 'scale(2.5)' ELSE 'scale(1.9)' END AS transform FROM documents",
)
def breakpoint_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", S.is_mobile(width).alias("mobile"), S.at_least(width, F.lit("scale(2.5)"), F.lit("scale(1.9)")).alias("transform"))


@REGISTRY.register(
    "path_dispatch",
    "SELECT page_id, CASE regexp_replace(url, '^[a-z]+://[^/]+', '') WHEN '/' THEN 'home' WHEN '' THEN 'home' ELSE 'not-found' END AS route FROM pages",
)
def path_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    return table(spark, sf_dir, "pages").select("page_id", S.routed(path, {"/": "home", "": "home"}, "not-found").alias("route"))


@REGISTRY.register(
    "format_block",
    """
    SELECT r.r_name AS chart, E'\\n [data-chart=' || r.r_name || E'] {\\n' || string_agg('  --color-' || n_name || ': c' || n_nationkey || ';', E'\\n' ORDER BY n_name)
           || E'\\n}\\n\\n\\n.dark [data-chart=' || r.r_name || E'] {\\n' || string_agg('  --color-' || n_name || ': ' || CASE WHEN n_nationkey % 2 = 0 THEN 'dark' ELSE 'c' END || n_nationkey || ';', E'\\n' ORDER BY n_name) || E'\\n}\\n' AS css
    FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name
    """,
)
def format_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    theme = F.when(key % 2 == 0, F.create_map(F.lit("dark"), F.concat(F.lit("dark"), key)))
    entry = F.struct(F.lit(None).cast("string").alias("label"), F.concat(F.lit("c"), key).alias("color"), theme.alias("theme"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    config = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", entry.alias("value"))), lambda a, b: F.when(a["n_name"] < b["n_name"], -1).otherwise(1)))
    grouped = nations.groupBy(F.col("r_name").alias("chart")).agg(config.alias("config"))
    return grouped.select("chart", S.style_text(F.col("config"), F.col("chart")).alias("css"))


@REGISTRY.register(
    "indirect_lookup",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views' ELSE 'Other' END AS label,
           CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views' ELSE 'Other' END AS nested_label,
           CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views' ELSE event_type END AS own_label FROM events
    """,
)
def indirect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda t: F.struct(F.lit(t).alias("label"))
    config = F.create_map(F.lit("click"), entry("Clicks"), F.lit("view"), entry("Views"), F.lit("kind"), entry("Other"))
    own = F.create_map(F.lit("kind"), F.col("event_type"))
    none = F.lit(None).cast("map<string,string>")
    found = S.payload_config(config, own, none, F.lit("kind"))["label"]
    inner = S.payload_config(config, F.create_map(F.lit("other"), F.lit("x")), own, F.lit("kind"))["label"]
    return table(spark, sf_dir, "events").select("event_id", found.alias("label"), inner.alias("nested_label"), S.own_label(config, F.col("event_type")).alias("own_label"))


@REGISTRY.register(
    "falsy_fallback",
    """
    SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'value') AS falsy,
           coalesce(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, 'value') AS nullish, 100 - coalesce(event_id % 5, 0) AS remaining FROM events
    """,
)
def falsy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", S.first_truthy(x, F.lit("value")).alias("falsy"), S.first_known(x, F.lit("value")).alias("nullish"), S.remaining(F.col("event_id") % 5).alias("remaining")
    )


@REGISTRY.register(
    "grouped_numbers",
    """
    SELECT o_orderkey, CASE WHEN x <> 0 THEN regexp_replace(regexp_replace(format('{:,.3f}', round(x, 3)), '0+$', ''), '[.]$', '') END AS total
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS x FROM orders)
    """,
)
def grouped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.grouped_number(x).alias("total"))


MERGED = [
    ("bg-red-500 bg-blue-600", "bg-blue-600"), ("px-2 p-4", "p-4"), ("flex hidden", "hidden"), ("text-sm text-center", "text-sm text-center"), ("p-4 px-2 hover:p-1", "p-4 px-2 hover:p-1"),
    ("own own w-1 size-2", "own own size-2"), ("brightness-50 brightness-100", "brightness-100"), ("overscroll-auto overscroll-contain", "overscroll-contain"), ("divide-x-2 divide-x-4", "divide-x-4"),
    ("accent-red-500 accent-blue-500", "accent-blue-500"), ("mix-blend-multiply mix-blend-screen", "mix-blend-screen"), ("will-change-auto will-change-scroll", "will-change-scroll"),
    ("hover:focus:p-1 focus:hover:p-2", "focus:hover:p-2"), ("[&>p]:hover:p-1 hover:[&>p]:p-2", "[&>p]:hover:p-1 hover:[&>p]:p-2"), ("md:hover:px-1 hover:md:px-2", "hover:md:px-2"),
    ("lining-nums tabular-nums normal-nums", "normal-nums"), ("scroll-px-2 scroll-p-4 scroll-smooth", "scroll-p-4 scroll-smooth"), ("snap-start snap-x snap-both", "snap-start snap-both"),
]


@REGISTRY.register(
    "class_merge",
    f"SELECT p_partkey, CASE p_partkey % {len(MERGED)} " + " ".join(f"WHEN {k} THEN '{merged}'" for k, (_, merged) in enumerate(MERGED)) + " END || ' m-' || p_size AS classes FROM part",
)
def class_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.get(F.array(*[F.lit(x) for x, _ in MERGED]), (F.col("p_partkey") % len(MERGED)).cast("int"))
    parts = F.array(F.lit("mt-2"), F.lit(None).cast("string"), F.lit(""), given, F.concat(F.lit("m-"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", class_names(parts).alias("classes"))


@REGISTRY.register(
    "list_helpers",
    """
    SELECT conv_id, min(turn) AS n_least, replace(first(role ORDER BY turn) || ':' || min(turn), ':', '') AS first_id, count(*) = 1 AS single, first(role ORDER BY turn) AS first_role,
           string_agg(coalesce(nullif(CASE WHEN role = 'user' THEN '' ELSE upper(role) END, ''), role), ',' ORDER BY turn) AS names
    FROM conversations GROUP BY conv_id
    """,
)
def list_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("turn", F.col("role").alias("name"), F.when(F.col("role") == "user", F.lit("")).otherwise(F.upper("role")).alias("label"))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("turn").alias("n_least"))
    first = S.first_item(F.col("items"))
    return lists.select(
        "conv_id", "n_least", S.without(F.concat(first["name"], F.lit(":"), F.col("n_least"))).alias("first_id"), S.is_single(F.col("items")).alias("single"),
        first["name"].alias("first_role"), F.array_join(S.projected(F.col("items"), "label", "name"), ",").alias("names"),
    )


@REGISTRY.register(
    "variant_defaults",
    """
    SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'h-8' WHEN c_nationkey % 3 = 1 THEN 'h-7' END AS size_class, c_custkey || '-item' AS item_id,
           CASE WHEN c_acctbal > 0 THEN 'expanded' ELSE 'collapsed' END AS state, NOT c_acctbal > 0 AS flipped, CASE WHEN c_nationkey = 1 THEN 'x' ELSE c_mktsegment END AS merged FROM customer
    """,
)
def variant_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.create_map(F.lit("default"), F.lit("h-8"), F.lit("sm"), F.lit("h-7"))
    asked = F.when(F.col("c_nationkey") % 3 == 1, F.lit("sm")).when(F.col("c_nationkey") % 3 == 2, F.lit("huge"))
    is_open = F.col("c_acctbal") > 0
    overrides = F.when(F.col("c_nationkey") == 1, F.create_map(F.lit("k"), F.lit("x")))
    merged = S.overridden(F.create_map(F.lit("k"), F.col("c_mktsegment")), overrides)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.variant(sizes, asked).alias("size_class"), S.derived_id(F.col("c_custkey").cast("string"), "-item").alias("item_id"),
        S.open_state(is_open).alias("state"), S.toggled(is_open).alias("flipped"), F.try_element_at(merged, F.lit("k")).alias("merged"),
    )


@REGISTRY.register(
    "key_value_sink",
    "SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value, max(ts) + INTERVAL 604800 SECONDS AS expires FROM events GROUP BY user_id",
)
def key_value_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "ts", F.struct("event_id", "event_type").alias("what"))
    return sinks.stored(events, "user", "what", "ts").select("key", F.col("value.event_type").alias("value"), "expires")


@REGISTRY.register(
    "literal_sections",
    """
    WITH s(idx, id, label) AS (VALUES (0, 'meet-us', 'Meet Us'), (1, 'cover-design', 'Cover Design'), (2, 'layout-design', 'Layout Design'),
           (3, 'illustrations', 'Illustrations'), (4, 'galore', 'Galore'), (5, 'corporate-design', 'Corporate Design'), (6, 'reach-us', 'Reach Us'))
    SELECT p_partkey, idx, id, label FROM part JOIN s ON idx = p_size % 7
    """,
)
def literal_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal sections in order, each part at one of them."""
    sections = F.broadcast(literals.ordered(spark))  # a few rows of code
    return table(spark, sf_dir, "part").join(sections, F.col("p_size") % 7 == F.col("idx")).select("p_partkey", "idx", "id", "label")


@REGISTRY.register("random_width", "SELECT event_id, (50 + ('0x' || substr(md5(event_id || '|7'), 1, 8))::BIGINT * 40 // 4294967296)::INT AS width FROM events")
def random_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.random_width(F.col("event_id"), 7).alias("width"))


@REGISTRY.register(
    "key_predicates",
    """
    SELECT event_id, (CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'ArrowLeft' ELSE 'ArrowRight' END) = 'b' AND event_id % 2 = 0 AS shortcut,
           coalesce((CASE event_id % 3 WHEN 1 THEN -1 WHEN 2 THEN 1 END)::VARCHAR, '') AS step FROM events
    """,
)
def key_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get(F.array(F.lit("b"), F.lit("ArrowLeft"), F.lit("ArrowRight")), (F.col("event_id") % 3).cast("int"))
    ctrl = F.when(F.col("event_id") % 2 == 0, F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", S.is_shortcut(key, F.lit(None).cast("boolean"), ctrl).alias("shortcut"), F.coalesce(S.arrow_step(key).cast("string"), F.lit("")).alias("step"))


@REGISTRY.register(
    "messages",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed ' || event_id WHEN event_type = 'view' THEN 'undefined' WHEN event_type = 'click' THEN NULL ELSE event_type END AS message,
           CASE WHEN event_type <> 'click' THEN event_type END AS children FROM events
    """,
)
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("failed "), F.col("event_id")))
    error = F.when(kind.isin("error", "view"), F.struct(text.alias("message")))
    children = F.when(kind != "click", kind).otherwise(F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", S.message(error, children).alias("message"), S.as_record(S.truthy(children))["children"].alias("children"))


@REGISTRY.register(
    "without_falsy",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'dev,' ELSE '' END || event_type AS kept, event_id % 2 = 1 AS empty FROM events",
)
def without_falsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("event_id") % 2 == 0, F.lit("dev"))
    kept = S.without_falsy(F.array(first, F.lit(""), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(kept, ",").alias("kept"), S.is_empty(S.without_falsy(F.array(first))).alias("empty"))


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, a file or a folder of files, as a bounded file stream."""
    schema = table(spark, sf_dir, name).schema
    # a stream takes a single file only by a pattern
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@REGISTRY.register(
    "store_stream",
    """
    WITH a AS (SELECT user_id AS store, event_id AS seq, ts, event_type FROM events WHERE event_type IN ('signup', 'error')),
    l AS (SELECT store, max(seq) FILTER (event_type = 'signup') AS seq, max(ts) AS last FROM a GROUP BY store),
    d AS (SELECT a.store, min(a.ts) AS first FROM a JOIN l ON a.store = l.store AND a.seq > l.seq GROUP BY a.store)
    SELECT l.store::VARCHAR AS store, l.seq::VARCHAR AS toast_id, d.first IS NULL AS open, 2 AS listeners FROM l LEFT JOIN d ON d.store = l.store
    WHERE l.seq IS NOT NULL AND (d.first IS NULL OR d.first + INTERVAL 1000 SECONDS > greatest(l.last, (SELECT max(ts) FROM a) - INTERVAL 600 SECONDS))
    """,
)
def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds and dismissals of all, folded as a stream to its end; two listeners get each batch. Dismissed records go when their timer is due."""
    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    actions = streamed(spark, sf_dir, "events").filter(kind.isin("signup", "error")).select(
        F.col("user_id").cast("string").alias("store"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(kind == "signup", F.lit("add")).otherwise(F.lit("dismiss")).alias("type"),
        F.when(kind == "signup", F.col("event_id").cast("string")).alias("toast_id"), none.alias("title"), none.alias("description"), F.lit(None).cast("boolean").alias("open"), F.array().cast("array<string>").alias("present"),
    )
    folder = _own_folder(spark, "store-stream")
    lists = [f"{folder}/first", f"{folder}/second"]
    store.run_to_end(store.store_stream(actions.withWatermark("at", "600 seconds")), folder, [store.batches_to(x) for x in lists])
    found = [spark.read.schema(f"{store.OUT}, batch int").option("basePath", x).parquet(x) for x in lists]
    seen = found[0].withColumn("listener", F.lit(1)).unionByName(found[1].withColumn("listener", F.lit(2)))
    last = seen.groupBy("store").agg(F.max(F.struct("batch", "toast_id", "open")).alias("last"), F.count_distinct("listener").cast("int").alias("listeners"))
    return last.filter("last.toast_id is not null").select("store", "last.toast_id", "last.open", "listeners")


@REGISTRY.register("slideshow_stream", "SELECT event_id, (event_id % 6)::INT AS main, (event_id % 3)::INT AS side FROM events")
def slideshow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = store.ticker(streamed(spark, sf_dir, "events").select("event_id"), {"main": 6, "side": 3}, "event_id")
    folder = _own_folder(spark, "slideshow")
    store.run_to_end(ticks, folder, [store.batches_to(f"{folder}/ticks")], "append")
    return spark.read.schema("event_id long, main int, side int").parquet(f"{folder}/ticks").select("event_id", "main", "side")


@REGISTRY.register(
    "unmatched_paths",
    "SELECT regexp_replace(url, '^[a-z]+://[^/]+', '') AS path, count(*) AS n FROM pages WHERE regexp_replace(url, '^[a-z]+://[^/]+', '') NOT IN ('/', '') GROUP BY ALL",
)
def unmatched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    pages = streamed(spark, sf_dir, "pages").select(path.alias("path"))
    folder = _own_folder(spark, "unmatched")
    known = pages.filter("path is not null")  # as in SQL
    unmatched = known.filter(S.routed(F.col("path"), {"/": "home", "": "home"}, "not-found") == "not-found")
    store.run_to_end(unmatched, folder, [sinks.unmatched_logged(folder=f"{folder}/paths")], "append")
    return spark.read.schema("path string, count long").parquet(f"{folder}/paths").groupBy("path").agg(F.sum("count").alias("n"))
