"""Queries that apply the operators of this subpackage to their whole tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import chosen_path, decontamination, language, linelabels, mixing, periodic, pii, planes, suffixes, tiff, toxicity, warc, whitening
from lakeshore.registry import Registry
from lakeshore.sources.tables import table

REGISTRY = Registry()
END_ID = 2


@REGISTRY.register("op1_planes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The model of all labels outside the held-out third."""
    return toxicity.fitted(documents, labels.filter(language.fold(F.col("doc_id"), 3) != 1))


@REGISTRY.register("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held_out = language.fold(F.col("doc_id"), 3) == 1
    return toxicity.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


@REGISTRY.register("op3_tiff")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.stored_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pixels = F.col("tiff.pixels")
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length(pixels).cast("long").alias("payload_bytes"),
        F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("tiff.feature").alias("feature"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""


@REGISTRY.register("op4_warc", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, hash(text) AS h,
                  md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
c AS (SELECT *, size - size % (1::BIGINT << greatest(0, length(bin(size)) - 5)) AS class, substr(k, 1, 2) AS part FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, source_size * 2.0::DOUBLE AS room FROM s),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM n),
r AS (SELECT *, room / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(room) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, [ratio, number]) AS final FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio <= final THEN room ELSE final * weight END AS target,
             ('0x' || substr(md5('mix-1|offset|' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off FROM l, f),
o AS (SELECT c.doc_id, c.size, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.part, c.k, c.size) AS rank
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + off) - floor((rank - 1) * rate + off))::BIGINT * size)::BIGINT AS taken FROM o
"""


@REGISTRY.register("op5_mixing", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return x.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item, ws, least(len(ws), 10) AS m, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM bp),
dp AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m),
h AS (SELECT dp.doc_id, dp.i, dp.m, w.item FROM dp JOIN w ON w.m = dp.m AND w.g = array_to_string(dp.ws[dp.i:dp.i + dp.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@REGISTRY.register("op7_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return x.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak.items").cast("binary"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def span_list(spans: str) -> Column:
    """kind:start:end of each span, by kind as the operator lists them, then start; comma-joined."""
    each = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.concat_ws(",", each)


@REGISTRY.register("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.found_in(docs, pii.fitted(docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    order = F.create_map(*[x for k, kind in enumerate(pii.LABELLED) for x in (F.lit(kind), F.lit(k))])
    rank = lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = found.withColumn("both", F.array_sort(F.transform(F.concat("base", "added"), rank)))
    return both.select("doc_id", *[of(k) for k in pii.KINDS], F.sha2(span_list("base").cast("binary"), 256).alias("base_sha256"), span_list("both").alias("spans"), F.size("added").cast("long").alias("n_added"))


@REGISTRY.register("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold(F.col("doc_id"), 5) == 0
    model = language.fitted(docs.filter(~held_out).select("text", "lang"))
    scored = language.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""


@REGISTRY.register("op10_chosen_path", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@REGISTRY.register("op6_suffixes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@REGISTRY.register("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fitted(rows)
    each = whitening.whitened(rows, model).select("vec_id", "n", "deviation", F.explode("components").alias("of"))
    return each.select("vec_id", "of.component", "n", "deviation", "of.whitened", "of.explained", F.lit(model.identity_error).cast("double").alias("identity_error"))


@REGISTRY.register("op12_linelabels")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(language.fold(F.col("doc_id"), 3) != 1)  # a third is held out to measure
    out = linelabels.judged(docs, linelabels.fitted(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", F.size("boilerplate").cast("long").alias("n_boilerplate"))


@REGISTRY.register("op13_periodic")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic.searched(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
