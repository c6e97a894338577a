"""Counts against plain Python, the field against all labellings, and held-out accuracy."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeshore.llm import language, linelabels, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside), failed


def counted(text):
    d = linelabels.described(text)
    return d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.failed


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab #|\n\t\x0b\x1c\x85  É𝒳.!"), max_size=300))
def test_counts(text):
    assert counted(text) == plain(text)


def test_counts_in_slices(monkeypatch):
    monkeypatch.setattr(linelabels, "SLICE", 7)
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["a", "bc", "É", " ", "\n", "|", ". "]) for _ in range(rng.randrange(120)))
        small = linelabels.described(text)
        assert counted(text) == plain(text)
        with monkeypatch.context() as whole:
            whole.setattr(linelabels, "SLICE", 1 << 20)
            assert np.array_equal(small.features, linelabels.described(text).features)


def test_repeated_windows_of_any_place():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        text = " ".join(words)
        assert linelabels.described(text).n_repeat_words == plain(text)[4]


def scored(model, own, labels):
    return sum(s for s, y in zip(own, labels) if y) + sum(model.after[a][b] for a, b in zip(labels, labels[1:]))


def test_field_against_all_labellings():
    rng = np.random.default_rng(4)
    for n in range(1, 8):
        model = linelabels.Model(rng.normal(size=len(linelabels.FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(linelabels.FEATURES)))
        own = x @ model.weights
        every = list(itertools.product((0, 1), repeat=n))
        value = np.array([scored(model, own, y) for y in every])
        assert tuple(model.labels(x).astype(int)) == every[int(value.argmax())]
        chance = np.exp(value - value.max())
        chance /= chance.sum()
        padded = np.zeros((2, 9))
        padded[0, :n] = own
        boiler, moved, norm = linelabels.sums(padded, model.after, np.array([n, 1]))
        assert np.allclose(boiler[0, :n], chance @ np.array(every)) and not boiler[0, n:].any()
        assert np.isclose(norm[0], np.log(np.exp(value).sum()))
        pairs = np.array([[sum(c * sum(p == (a, b) for p in zip(y, y[1:])) for c, y in zip(chance, every)) for b in (0, 1)] for a in (0, 1)])
        assert np.allclose(moved, pairs)


def test_neighbours_matter():
    weights = np.zeros(len(linelabels.FEATURES))
    weights[0] = 0.5  # each line leans to boilerplate
    x = np.zeros((5, len(linelabels.FEATURES)))
    x[:, 0] = [-3, 1, -3, 1, 1]
    alone = linelabels.Model(weights)
    chained = linelabels.Model(weights, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert alone.labels(x).tolist() == [False, True, False, True, True] and chained.labels(x).tolist() == [False] * 5


NAV = "Home | News | About\n"
PROSE = "This is a sentence of plain words that goes on for a while. Another one follows it here and ends as well.\n"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def test_operator_learns_and_filters(spark):
    rng = random.Random(1)
    prose = lambda n: "".join(" ".join(rng.choice("the of plain words go here and there on some day".split()) for _ in range(14)).capitalize() + ".\n" for _ in range(n))
    menu = lambda n: "".join(" | ".join(rng.choice("Home News Sport Help Shop Login".split()) for _ in range(8)) + "\n" for _ in range(n))
    rows = [(i, prose(5) if i % 2 else menu(5), "x") for i in range(200)]
    docs, labels = table(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 0), (5000, 1), (7, None)], "doc_id long, quality int")
    model = linelabels.fitted(docs, labels)
    odd = [(300, None, "x"), (301, "", "x"), (302, " \n\t\n", "x"), (303, menu(2) + prose(6), "x"), (304, menu(12) + prose(3), "x"), (None, prose(6), "x"), (303, menu(2) + prose(6), "x")]
    out = linelabels.judged(table(spark, odd), model)
    got = sorted(((r.doc_id or 0, r.kept, r.boilerplate, r.kept_own) for r in out.collect()), key=str)
    assert got == sorted([(300, False, [], "x"), (301, False, [], "x"), (302, False, [], "x"), (303, True, [0, 1], "x"), (304, False, list(range(12)), "x"), (0, True, [], "x"), (303, True, [0, 1], "x")], key=str)
    kept = linelabels.filtered(table(spark, odd), model)
    assert kept.columns == ["doc_id", "text", "kept"] and sorted(str(r.doc_id) for r in kept.collect()) == ["303", "303", "None"]
    assert linelabels.judged(docs.limit(0), model).count() == 0


def test_without_labels_all_lines_are_content(spark):
    docs = table(spark, [(1, NAV * 10, "")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 0)], "doc_id long, quality int")):
        model = linelabels.fitted(docs, labels)
        assert not model.weights.any()
    r = linelabels.judged(docs, model).first()
    assert (r.content_share, r.base_failed, r.kept) == (1.0, True, False)


def test_long_text_with_long_lines():
    text = ("word " * 300_000 + "\n") * 2 + PROSE * 2000
    d = linelabels.described(text)
    assert d.n_words == len(text.split()) and len(d.lines) == 2002 and d.n_dup_lines == 2000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_counts_and_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.REGISTRY.queries["op12_linelabels"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.select("doc_id", "text").collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(r.text)
        assert not (x.base_failed and x.kept)
    held = spark.read.parquet(f"{SF}/labels.parquet").filter(language.fold(F.col("doc_id"), 3) == 1).collect()
    good = [got[r.doc_id].kept for r in held if r.quality == 1 and not got[r.doc_id].base_failed]
    poor = [got[r.doc_id].kept for r in held if r.quality == 0]
    assert len(good) > 50 and sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)
