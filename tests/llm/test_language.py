import math
import random
from collections import Counter

import numpy as np
import pytest

from lakeshore.llm import language


def naive_bits(train, text):
    """Code length of a text after training texts, context by context."""
    counts = {}
    for t in train:
        data = b"\n" * language.ORDER + t.encode().lower()
        for k in range(language.ORDER, len(data)):
            for n in range(language.ORDER + 1):
                counts.setdefault(data[k - n : k], Counter())[data[k]] += 1
    data, total = b"\n" * language.ORDER + text.encode().lower(), 0.0
    for k in range(language.ORDER, len(data)):
        for n in range(language.ORDER, -1, -1):
            seen = counts.get(data[k - n : k])
            if not seen:
                continue
            size = sum(seen.values())
            if data[k] in seen:
                total -= math.log2(seen[data[k]] / (size + len(seen)))
                break
            total -= math.log2(len(seen) / (size + len(seen)))
        else:
            total += 8
    return total


TRAIN = {"aa": ["banana band", "a bandana ban", "nab a banana"], "bb": ["llama éla", "mallé alla lamé"]}


def test_code_lengths_like_naive():
    counts = {}
    for lang, texts in TRAIN.items():
        found = np.concatenate([language.grams(language._lead(t), language.ORDER + 1) for t in texts])
        counts[lang] = np.unique(found, return_counts=True)
    model = language.Model(counts)
    texts = ["banana", "llamé", "xyz é ban", "b", "a" * 50]
    got = model.lengths(texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx([naive_bits(TRAIN[k], text) for k in model.langs], rel=1e-5)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 5000).astype(np.uint32))
    asked = np.concatenate((keys, rng.integers(0, 1 << 32, 5000).astype(np.uint32)))
    place = {int(k): i for i, k in enumerate(keys)}
    assert language.Lookup(keys).rows(asked).tolist() == [place.get(int(k), -1) for k in asked]


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ein", "lich", "ü"], "fr": ["eau", "é", "tion", "ou"]}
    rows = [(k, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(20)), g) for k in range(300) for g in [rng.choice(list(parts))]]
    docs = spark.createDataFrame(rows + [(None, None, "en"), (900, "", "en"), (901, "123 !?", "de"), (902, "the thing", None)], "doc_id long, text string, lang string")
    model = language.fitted(docs.filter("doc_id % 2 = 0"))
    out = language.identified(docs.withColumnRenamed("lang", "lang_true"), model).collect()
    assert len(out) == 304
    for r in out:
        if r.doc_id is None or r.doc_id in (900, 901):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.lang_true:
            assert r.lang_pred == r.lang_true and 0.3 < r.score <= 1


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    (row,) = language.identified(docs, language.fitted(docs)).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert language.identified(docs.filter("false"), language.fitted(docs)).collect() == []


def test_numerals_are_no_letters():
    assert not any(language.has_letter(t) for t in ("²", "½", "Ⅷ", "1_000", "٣", "", "— …"))
    assert all(language.has_letter(t) for t in ("a", "² é", "字", "ª", "Ⅷ x"))
