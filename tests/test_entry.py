import __spark_entry__


def test_every_query_runs_on_the_smallest_tables(spark):
    from lakeshore.plans import catalog

    for name, query in catalog.REGISTRY.queries.items():
        assert query(spark, "/root/testdata/sf0.001").columns, name
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_oracle_on_the_smallest_tables(spark):
    import duckdb

    from lakeshore.plans import catalog

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else str(v)
    for name, sql in catalog.REGISTRY.oracles.items():
        got = catalog.REGISTRY.queries[name](spark, "/root/testdata/sf0.001")
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns, name
        a = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
        b = sorted(tuple(map(plain, r)) for r in want.select(*columns).fetchall())
        assert a == b, name


def test_streams_of_tables_that_are_folders(spark, tmp_path):
    """Tables of part files, in partitions or not, are streamed like single files; a page without a url has no path."""
    import duckdb

    from lakeshore.plans import catalog

    con = duckdb.connect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(900, None, "x"), (901, "http://a.b", "x")], "page_id long, url string, html string"))
    pages.selectExpr("*", "page_id % 2 AS half").write.partitionBy("half").parquet(f"file://{tmp_path}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    pages.limit(5).write.parquet(f"file://{tmp_path}/pages_old.parquet")  # another table, whose name begins alike
    for t in ("pages", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/**/*.parquet'")
    for name in ("unmatched_paths", "slideshow_stream", "store_stream"):
        got, want = catalog.REGISTRY.queries[name](spark, f"file://{tmp_path}"), con.sql(catalog.REGISTRY.oracles[name])
        assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall())), name
