"""The tables and scalar operators in the session's catalog, for queries by SQL text. Driver-contract scope: the reference has no SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeshore.functions import table_functions
from lakeshore.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SQL functions: name, parameters, result, body. Spark puts a body in place of its call, so a query plans as if it was written out.
FUNCTIONS = [
    ("first_truthy", "a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), b)"),
    ("remaining", "value DOUBLE", "DOUBLE", "100 - coalesce(CASE WHEN value <> 0 AND NOT isnan(value) THEN value END, 0)"),
    ("is_mobile", "width BIGINT", "BOOLEAN", "coalesce(width < 768, false)"),
    ("at_least", "width BIGINT, yes STRING, no STRING", "STRING", "CASE WHEN width >= 1024 THEN yes ELSE no END"),
    ("path_of", "url STRING", "STRING", "regexp_replace(url, '^[a-z]+://[^/]+', '')"),
    ("routed", "path STRING", "STRING", "CASE WHEN path = '/' THEN 'home' WHEN path = '' THEN 'home' ELSE 'not-found' END"),
    ("scroll_target", "offset_top INT", "INT", "offset_top - 80"),
]


def surface(spark: SparkSession, sf_dir: str) -> None:
    """Each table below ``sf_dir`` as a temporary view, and each of FUNCTIONS and ``streaks`` as a temporary function; what has such a name is
    replaced."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    table_functions.registered(spark)


#: Queries of the catalog by text; each must give the rows of the query of its name.
SQL_QUERIES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02' GROUP BY l_returnflag, l_linestatus
        """,
    "breakpoint_flag": "SELECT doc_id, is_mobile(n_chars) AS mobile, at_least(n_chars, 'scale(2.5)', 'scale(1.9)') AS transform FROM documents",
    "path_dispatch": "SELECT page_id, routed(path_of(url)) AS route FROM pages",
    "keyed_delete": "SELECT doc_id, source FROM documents LEFT ANTI JOIN labels USING (doc_id)",
    "first_request_expiry": "SELECT user_id, min(ts) AS requested, min(ts) + INTERVAL 1000 SECONDS AS expires FROM events WHERE event_type = 'error' AND user_id IS NOT NULL GROUP BY user_id",
    "event_streaks": """
        SELECT value, first_at, last_at, n FROM streaks(TABLE(SELECT user_id, to_date(ts) AS day, ts, event_id, event_type FROM events)
                                                        PARTITION BY (user_id, day) ORDER BY (ts, event_id), 'event_type', 'ts')
        """,
}
