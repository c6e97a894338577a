"""Mixing sources to target weights by systematic sampling.

Each source gets a target (its weight's share of the asked size, at most ``most`` times what it has, the excess
reshared by weight). Each of its documents has target / size expected copies; along a fixed order of the source's
documents these are summed, one random offset is added, and a document is emitted once for each integer that its sum passes.

The order goes by size class, then by a hash, so copies spread evenly over sizes. Ranks come from counts of (source,
bucket) plus a rank inside the bucket, never from one sort of a whole source.

Cases: a null or blank text has size 0 and is counted, but adds nothing; a null source is a source, ordered last;
documents that repeat an id or are equal keep their rows; those without an id are ordered by a hash of all their columns;
an empty table gives an empty mix; extra columns are kept, those of added names as name_own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.shared import numbered, set_aside, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): a row for each source, so windows over all of them stay small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.lit(WEIGHTS[0])
    for k, w in enumerate(WEIGHTS[1:], 1):
        weight = F.when(F.col("number") % len(WEIGHTS) == k, w).otherwise(weight)
    x = totals.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    x = x.withColumn("room", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("room") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "number")
    all_rows = Window.partitionBy()
    x = x.withColumns({
        "all_size": F.sum("source_size").over(all_rows),
        "full_before": F.coalesce(F.sum("room").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    x = x.withColumn("level", (F.col("all_size") * F.lit(share) - F.col("full_before")) / F.col("weight_left"))
    is_open = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "number", "level"))
    x = x.withColumn("final", F.min(is_open).over(all_rows)["level"])
    target = F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("room")).otherwise(F.col("final") * F.col("weight"))
    return x.withColumn("target", target).select("source", "source_size", "target")


def mixed(docs: DataFrame, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (0, 1 or 2 for the default limits)."""
    docs = set_aside(docs, *ADDED)
    names = docs.columns
    docs = numbered(docs)
    own = docs.columns
    place = dict(zip(names, own))
    docs = docs.withColumns({"doc_id": F.col(place["doc_id"]), "source": F.col(place["source"]), "mix_size": word_count(F.col(place["text"])), "mix_text": F.xxhash64(place["text"])})
    size_class = F.col("mix_size") - F.pmod(F.col("mix_size"), F.expr("shiftleft(1L, greatest(0, length(bin(mix_size)) - 5))"))
    whole = F.xxhash64(*[f.name for f in docs.schema if f.name in own and "map<" not in f.dataType.simpleString()])  # rows without an id are told apart by all they hold
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), whole.cast("string")))))
    x = docs.withColumns({"mix_class": size_class, "mix_key": key}).withColumn("mix_part", F.substring("mix_key", 1, 2))
    bucket = ["source", "mix_class", "mix_part"]
    counts = staged(x.groupBy(*bucket).agg(F.count("*").alias("mix_n"), F.sum("mix_size").alias("mix_words")), "mix-counts")
    goals = targets(counts.groupBy("source").agg(F.sum("mix_words").alias("source_size")), share, most)
    along = Window.partitionBy("source").orderBy("mix_class", "mix_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(along), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("offset"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    places = (
        places.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("mix_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("mix_offset", offset)
        .select(*[F.col(c).alias(f"at_{c}") for c in bucket], "mix_before", "mix_rate", "mix_offset", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    )
    inside = Window.partitionBy(*bucket).orderBy("mix_key", "mix_size", "mix_text")
    x = x.withColumn("mix_at", F.row_number().over(inside)).join(places, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in bucket])
    rank = F.col("mix_before") + F.col("mix_at")
    passed = lambda n: F.floor(n * F.col("mix_rate") + F.col("mix_offset"))
    x = x.withColumn("mix_copies", passed(rank) - passed(rank - 1)).select(*own, *ADDED)
    return x.toDF(*names, *ADDED)


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken."""
    x = mixed(docs, **how)
    own = [f"own_{k}" for k in range(len(docs.columns))]
    x = x.toDF(*own, *ADDED).filter(F.col("mix_copies") > 0)
    return x.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*own).toDF(*docs.columns)
