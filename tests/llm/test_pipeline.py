import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_chosen_path import brute_force as near_copies
from test_decontamination import naive_words
from test_mixing import filled
from tokenizers import Tokenizer

import corpus_pipeline
from lakeshore.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, raw = docs.columns, {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        seen.append((name, docs.columns, docs.collect()))
    assert all(c == columns for _, c, _ in seen[:-1])
    clean, apart, free, mix, ids = (rows for *_, rows in seen)
    assert {r.doc_id for r in clean} >= set(raw) - toxic
    assert len({r.doc_id for r in apart}) == len(apart) < len(clean)
    assert {r.doc_id for r in mix} <= {r.doc_id for r in free}
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mix)
    at = 0
    for r in sorted(ids, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def planted(spark, folder):
    """Texts with insults (k % 5 == 0), near copies (from 1000 on) and benchmark passages (k % 7 == 3; 2000 is little else)."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "er", "lo", "ti", "mu", "sa", "ko", "be"]) for _ in range(4))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts = {}
    for k in range(400):
        t = [word() for _ in range(50)]
        if k % 7 == 3:
            t[25:25] = items[k % 5][1].split()[2:17]
        if k % 5 == 0:
            for at in rng.sample(range(20), 4):
                t[at] = rng.choice(["vermin", "zork" + word()])
        texts[k] = " ".join(t)
        if k % 9 == 4 and k % 5:
            texts[1000 + k] = " ".join([*t[:-1], word()])
    texts[2000] = items[0][1] + " and more"
    rows = [(k, t, "en", "abc"[k % 3], len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 400 and k % 5 == 0)) for k in texts], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_each_stage_like_plain_python(spark, tmp_path):
    folder = f"file://{tmp_path}"
    items = planted(spark, folder)
    docs, seen = table(spark, folder, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        seen.append([tuple(r) for r in docs.collect()])
        docs = stage(spark, docs, folder).persist()
    raw, clean, apart, free, mix = seen
    assert sorted(clean) == sorted(r for r in raw if r[0] >= 400 or r[0] % 5)
    heads = {int(r[0]) for r in near_copies(clean) if r[3]}
    assert sorted(apart) == sorted(r for r in clean if r[0] in heads) and len(apart) < len(clean) - 20
    windows = {tuple(w[k : k + 10]) for w in (naive_words(t) for _, t in items) for k in range(len(w) - 9)}
    expected, leaks = {}, 0
    for r in apart:
        w = naive_words(r[1])
        hit = {i for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for i in range(k, k + 10)}
        leaks += bool(hit)
        if len(hit) <= len(w) * 0.5:
            expected[r[0]] = [x for i, x in enumerate(w) if i not in hit]
    assert {r[0]: naive_words(r[1]) for r in free} == expected and leaks > 20 and 2000 not in expected and len(free) == len(expected)
    sizes = Counter()
    for r in free:
        sizes[r[3]] += len(r[1].split())
    goal, copies = filled(sizes), Counter(mix)
    assert set(copies) <= set(free)
    for r in free:
        share = goal[r[3]] / sizes[r[3]]
        assert math.floor(share + 1e-9) <= copies[r] <= math.ceil(share - 1e-9)
    for source in sizes:
        assert abs(sum(len(r[1].split()) for r in mix if r[3] == source) - goal[source]) <= 70 + 0.02 * goal[source]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*whole.encode(r[1], add_special_tokens=False).ids, 2]) for r in mix]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in docs.collect()) == sorted((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score int, leak string, mix_copies string, kept int"


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, columns named like what operators add."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice(["an", "er", "lo", "ti"]) for _ in range(4)) for _ in range(n))
    full = [(k, words(30), "en", "ab"[k % 2], 1, k, "x", "y", k) for k in range(20)]
    odd = [
        (None, words(20), "en", "a", 1, 1, "x", "y", 1),
        (100, None, None, None, None, None, None, None, None),
        (101, "", "en", "a", 0, None, "x", None, 2),
        (102, words(200_000), "en", None, None, 3, None, "y", None),
        full[3],
        full[3],
    ]
    return full + odd


def test_odd_rows_pass_every_stage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    planted(spark, folder)
    docs = spark.createDataFrame(odd_rows(), ODD)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        kept = [r for r in docs.collect() if name != "mixing"]
        if kept:  # nothing here is toxic, alike or leaked but the repeated rows
            assert len(kept) == len(odd_rows()) - (0 if name == "toxicity" else 2), name
            assert sum(r.doc_id is None for r in kept) == 1 and sum(r.text is None for r in kept) == 1
            assert max(len(r.text or "") for r in kept) > 1_000_000
            assert {r.score for r in kept if r.doc_id is not None and r.doc_id < 20} == set(range(20))
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(ids) == docs.count() and {r.n_tokens for r in ids if r.doc_id in (100, 101)} <= {1}


def test_empty_table_passes_every_stage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    planted(spark, folder)
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name
