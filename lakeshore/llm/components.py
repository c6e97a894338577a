"""Connected components of a table of links, by hooking to the smallest neighbour, jumping pointers and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import compact, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): label is the smallest node that can be reached.

    Each round every node points to its smallest neighbour (or itself), pointers jump twice, and links are rewritten to
    where their ends point; each round's tables are written to the shared folder, in as many files as their rows fill. Rounds
    grow with the logarithm of the longest path. Null ends are ignored; an empty table gives an empty table.
    """
    links = staged(links.select("a", "b").filter("a != b").distinct(), "links")
    ends = lambda x: x.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(x.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels, many = None, 0
    n = links.count()
    while True:
        pointed = ends(links).groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
        points = staged(compact(pointed, 2 * n), "points")
        for _ in range(2):
            far = points.select(F.col("node").alias("label"), F.col("label").alias("further"))
            points = points.join(far, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
        points = staged(compact(points, 2 * n), "points")
        if labels is None:
            labels, many = points, 2 * n
        else:
            far = points.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = staged(compact(labels.join(far, "label", "left").select("node", F.coalesce("further", "label").alias("label")), many), "labels")
        to = lambda end: points.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
        rest = links.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a != b")
        links = staged(compact(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n), "links")
        n = links.count()
        if not n:
            return labels
