"""Every operator on one table of very long, empty, null and repeated texts, with columns named like what operators use or add."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeshore.llm import chosen_path, decontamination, language, linelabels, mixing, periodic, pii, planes, suffixes, tiff, toxicity, warc

NAMES = ["score", "predicted", "base", "added", "tiff", "leak", "raw", "digest", "spans", "media", "n_bytes", "rep", "label", "node", "mix_size", "lang_pred", "anchors", "kept"]


def long_text():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    return " ".join(rng.choice(words) for _ in range(450_000))  # over 3 MB


@pytest.fixture(scope="module")
def rows():
    long = long_text()
    return [(1, long), (2, ""), (3, None), (None, "some words of a row without id here"), (5, long[1_000_000:1_000_900] + " tail"), (6, "same text twice over and over"), (6, "same text twice over and over")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    x = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return x.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]).persist()


def own_columns_stay(out):
    first = out.first()
    for k, name in enumerate(NAMES):
        kept = [c for c in out.columns if c == name or c.startswith(f"{name}_own")]
        assert any(first[c] == k for c in kept), name


def test_planes(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = planes.tokenized(docs, path, 2, with_ids=True).collect()
    whole = Tokenizer.from_file(path)
    want = sorted(str([*whole.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows)
    assert sorted(str(list(r.ids)) for r in got) == want


def test_warc(docs, rows):
    got = warc.archived(docs.withColumn("url", F.lit("u")), id_col="doc_id", payload_col="text").collect()
    assert sorted(r.payload_digest for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sum(r.record_type == "revisit" for r in got) == 0  # the equal rows are short


def test_linelabels(docs, rows):
    out = linelabels.judged(docs, linelabels.Model())
    own_columns_stay(out)
    assert sorted(r.n_words for r in out.select("n_words").collect()) == sorted(len((t or "").split()) for _, t in rows)


def test_periodic(docs, rows):
    out = periodic.searched(docs)
    own_columns_stay(out)
    assert sorted(r.collapsed for r in out.select("collapsed").collect()) == sorted(t or "" for _, t in rows)


def test_toxicity(spark, docs, rows):
    model = toxicity.Model({"abc": 1.0}, toxicity.PRIOR)
    out = toxicity.scored(docs, model)
    own_columns_stay(out)
    assert sorted(r.score for r in out.collect()) == sorted(model.score(t) for _, t in rows)
    assert toxicity.cleaned(docs, model).columns == docs.columns


def test_tiff(docs, rows):
    out = tiff.stored_and_read(docs)
    own_columns_stay(out)
    got = sorted(bytes(r.tiff.pixels).rstrip(b"\0").decode() for r in out.collect())
    assert got == sorted(t or "" for _, t in rows)


def test_mixing(docs, rows):
    out = mixing.mixed(docs)
    own_columns_stay(out)
    assert out.columns.count("mix_size") == 1 and mixing.emitted(docs).columns == docs.columns
    assert sorted(r.mix_size for r in out.select("mix_size").collect()) == sorted(len((t or "").split()) for _, t in rows)


def test_suffixes(docs, rows):
    got = {r.doc_id: r for r in suffixes.deduplicated(docs).collect()}
    assert got[1].n_bytes == len(rows[0][1]) and got[1].n_removed == 900 and got[1].n_spans == 1
    assert (got[5].n_removed, got[5].n_spans, got[3].n_bytes, got[6].n_removed) == (900, 1, 0, 0)


def test_decontamination(spark, docs, rows):
    item = " ".join(rows[0][1].split()[200_000:200_014])
    out = decontamination.contamination(docs, spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"), keep_text=False)
    own_columns_stay(out)
    got = {r.doc_id: r.leak for r in out.collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (450_000, 14, ["1"]) and got[3].n_words == got[2].n_words == 0


def test_pii(spark, docs):
    seen = spark.createDataFrame([(f"mail m{k}@host.org from 10.0.0.{k} or {k}",) for k in range(60)], "text string")
    model = pii.fitted(seen)
    assert model.trained
    out = pii.found_in(docs, model)
    own_columns_stay(out)
    assert all(not r.base and not r.added for r in out.filter("doc_id = 1").select("base", "added").collect())


def test_language(spark, docs):
    known = spark.createDataFrame([("abc def gha", "x"), ("mno pqr stu", "y")], "text string, lang string")
    out = language.identified(docs, language.fitted(known))
    own_columns_stay(out)
    got = {r.doc_id: r.lang_pred for r in out.select("doc_id", F.col("lang_pred")).collect()}
    assert got[1] == "x" and got[2] == got[3] == "und"


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r for r in chosen_path.near_duplicates(docs).collect()}
    words = rows[0][1].split()
    assert got[1].n_shingles == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert all(r.kept for r in got.values()) and got[3].n_shingles == 0
    assert chosen_path.deduplicated(docs).count() == len(rows) - 1
