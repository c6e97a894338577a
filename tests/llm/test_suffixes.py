import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.llm import suffixes


def brute_force(rows):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[k : k + 400] for k in range(len(raw) - 399))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        flags = np.zeros(len(raw), bool)
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                flags[k : k + 400] = True
        kept = bytes(b for b, f in zip(raw, flags) if not f)
        out.append((str(doc_id), len(raw), int(flags.sum()), len(suffixes.ranges_of(flags)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + 1 + seed, 700).astype(np.uint8)
    data[100:300] = data[400:600]
    data[650] = 255
    raw = data.tobytes()
    order, _ = suffixes.suffix_order(data, 700)
    assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    assert suffixes.smaller_than_next(data).tolist() == [raw[k:] < raw[k + 1 :] for k in range(len(raw))]


def test_many_names(monkeypatch):
    data = np.random.default_rng(9).integers(0, 5, 3000).astype(np.uint64) + np.uint64(1 << 21)
    raw = [tuple(data[k : k + 3].tolist()) for k in range(2990)]
    got = suffixes._three(data, np.arange(2990), 1)
    assert np.array_equal(np.unique(got, return_inverse=True)[1], [sorted(set(raw)).index(r) for r in raw])


def corpus():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    passage, long = text(900), text(3000)
    texts = [None, "", "short", passage[:398], long, long[:1500] + "#" + long[1501:], long[5:2990], "ab" * 900, "z" * 2500, passage, passage]
    texts += [text(rng.randrange(700)) + passage[rng.randrange(60) : 700 + rng.randrange(200)] + text(rng.randrange(700)) for _ in range(40)]
    texts += [long[:1000] + str(k) + long[1000:] for k in range(12)]
    texts += [text(500) for _ in range(20)] + ["z" * n for n in (400, 401, 450, 1500)] + ["q" * 399, "p" * 401, "ab" * 230]
    return [(k if k != 9 else None, t) for k, t in enumerate(texts)] + [(3, long[:450]), (60, text(800))]


@pytest.mark.parametrize("heavy", [1 << 20, 3000, 10])
def test_like_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "ANCHOR_BYTES", heavy)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows)


def test_copies_of_hot_pieces_are_cut_once(spark, monkeypatch):
    """Anchors that are hot at every length: what is cut again grows with the different pieces, not with their copies."""
    monkeypatch.setattr(suffixes, "ANCHOR_BYTES", 10)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, inner = suffixes._cut_again, []
    shared = text(1500)
    cut = []
    monkeypatch.setattr(suffixes, "_cut_again", lambda x, gram: cut.append(x.count()) or passage(x, gram))
    for n in (5, 50):
        rows = [(k, text(30) + shared + text(30)) for k in range(n)]
        got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows)
        inner.append(sum(cut))
        cut.clear()
    assert inner[1] < 4 * inner[0] + 4 * 50 * 4  # the ends differ from copy to copy


def test_segments_of_long_texts(monkeypatch):
    raw = corpus()[4][1].encode() + b"z" * 900
    whole = [x for part in suffixes.pieces(raw, 200) for x in zip(*(v.tolist() for v in part))]
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    cut = [x for part in suffixes.pieces(raw, 200) for x in zip(*(v.tolist() for v in part))]
    of = lambda rows: {first + k: anchor for anchor, first, many, _ in rows for k in range(many)}
    assert of(cut) == of(whole) and sorted(of(cut)) == list(range(len(raw) - 399)) and len(cut) > len(whole)


def test_empty(spark):
    assert suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("own_id", [None, 7])
def test_rows_of_one_id_cost_no_square(spark, monkeypatch, own_id):
    """Texts without an id, and many copies of a row under one id, are each cut once."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = text(450), text(600)
    rows = [(None, text(40) + passage) for _ in range(3000)] + [(own_id, copy)] * 3000
    cut, real = [], suffixes._cut
    monkeypatch.setattr(suffixes, "_cut", lambda texts: cut.append(texts.count()) or real(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.deduplicated(frame).groupBy("n_bytes").agg(F.count("*"), F.min("n_removed"), F.max("n_spans")).collect()
    got_least = min(r[2] for r in got)
    assert sorted(tuple(r) for r in got) == [(490, 3000, got_least, 1), (600, 3000, 600, 1)] and got_least >= 450
    assert cut == [3001]


@pytest.mark.parametrize("heavy", [1 << 20, 10])
def test_pieces_are_not_joined_with_their_copies(spark, monkeypatch, heavy):
    """Copies of a piece are known by their count; only pieces that occur once send anything to their texts."""
    monkeypatch.setattr(suffixes, "ANCHOR_BYTES", heavy)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(6000)
    rows = [(k, text(30) + shared + text(30)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *_, partly = suffixes.repeats(docs)
    joins = [line for line in partly._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "piece_key" in line]
    sent, real = [], suffixes._alone

    def counted(distinct):
        out = real(distinct).cache()
        sent.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "_alone", counted)
    got = suffixes.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows)
    assert 0 < sum(sent) <= 50 * 62  # at most a row for each string that takes in an end of its own
