"""A training corpus from raw documents: five stages, each a table of documents for the next one.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and works on all of them; its result is
written as Parquet and read again before the next stage. The last one returns a row for each document it encoded.

Cases: a null or empty text is clean, is near no other, leaks nothing, has size 0, so the mix takes it as often as its source's share
says, and becomes the end id alone; a null id is near no other and keeps its row; equal rows of one id become one in the second stage; a
null source is a source; texts of any length go whole through every stage; an empty table gives an empty table of the same columns;
extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import chosen_path, decontamination, language, mixing, planes, toxicity
from lakeshore.llm.shared import staged
from lakeshore.sources.tables import table

#: No SQL: learned scores, signatures and tokenizers are not SQL's; the stages are tested against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels outside the held-out third, does not reject."""
    labels = table(spark, sf_dir, "labels").filter(language.fold(F.col("doc_id"), 3) != 1)
    return toxicity.cleaned(docs, toxicity.fitted(docs, labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    return chosen_path.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with test items; those that are mostly such passages go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mixing.emitted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and write shard files; a row for each document read back: doc_id, start, n_tokens, ids_crc32."""
    return planes.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
