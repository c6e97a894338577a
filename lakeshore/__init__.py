"""lakeshore: Spark-first keyed-state, lookup and scalar operators, checked against SQL."""
