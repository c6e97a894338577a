"""Runs against a search of every period and place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeshore.llm import periodic, queries


def plain_runs(words):
    """Every stretch by every period, smallest periods first; a stretch that a divisor of its period explains is none."""
    n, out, taken = len(words), [], set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p) and (i, j + p) not in taken:
                taken.add((i, j + p))
                out.append((i, j + p - i, p))
            i = j
    return sorted(out)


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:])))


def ids(words):
    return periodic.numbered_words([str(w).encode() for w in words])


block = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 9))


@settings(max_examples=400, deadline=None)
@given(st.lists(block, max_size=7))
def test_runs_of_blocks(blocks):
    words = [w for unit, times in blocks for w in unit * times]
    found = periodic.runs(ids(words))
    assert found == plain_runs(words)
    for start, length, period in found:
        assert smallest_period(words[start : start + length]) == period


@pytest.mark.parametrize("seed", range(6))
def test_runs_in_long_texts(seed, monkeypatch):
    monkeypatch.setattr(periodic, "PROBES", 500)  # many pieces of the grid
    rng = random.Random(seed)
    words = []
    for _ in range(12):
        unit = [rng.randrange(60) for _ in range(rng.choice([1, 2, 5, 8, 24, 60]))]
        words += unit * rng.randrange(1, 6) + [rng.randrange(60) for _ in range(rng.randrange(30))]
    assert periodic.runs(ids(words)) == plain_runs(words)


def test_shortest_runs_and_edges():
    assert periodic.runs(ids([])) == [] and periodic.runs(ids("a")) == []
    assert periodic.runs(ids("a" * 23)) == [] and periodic.runs(ids("a" * 24)) == [(0, 24, 1)]
    assert periodic.runs(ids("ab" * 12)) == [(0, 24, 2)]
    unit = list(range(9))
    assert periodic.runs(ids(unit * 3)) == [(0, 27, 9)] and periodic.runs(ids((unit * 3)[:-1])) == []
    # nested: a run of period 25 whose unit holds a run of period 1
    words = (["x"] * 24 + ["y"]) * 3
    assert periodic.runs(ids(words)) == [(0, 24, 1), (0, 75, 25), (25, 24, 1), (50, 24, 1)]


def test_one_word_many_times_is_one_run():
    assert periodic.runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]


def test_strongest_breaks_ties_by_start_then_period():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(0, 30, 10), (5, 24, 8), (9, 33, 10)]) == (9, 33, 10)
    assert periodic.strongest([(3, 24, 8), (3, 30, 10), (40, 24, 8)]) == (3, 24, 8)


def test_collapsed_keeps_the_first_period_of_each_run():
    assert periodic.collapsed([b"a"] * 30 + [b"b"], [(0, 30, 1)]) == [b"a", b"b"]
    words = [b"x", *[b"a", b"b", b"c"] * 9, b"y"]
    assert periodic.collapsed(words, periodic.runs(periodic.numbered_words(words))) == [b"x", b"a", b"b", b"c", b"y"]


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found).encode()
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *strongest, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \t\x0b\n"), (4, "é é   " * 30), (4, "é é   " * 30), (5, "x　y " * 26)]
    for k in range(6, 160):
        rows.append((k, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(90)))))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.REGISTRY.queries["op13_periodic"](spark, str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(expected(*r)) for r in rows)


def test_operator_keeps_columns_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([("w " * 30, 7, 8), (None, 1, 2)], "text string, runs int, _words int")
    out = periodic.searched(docs)
    assert out.columns == ["text", "runs_own", "_words", "runs", "strongest", "collapsed"]
    first = out.filter("text is not null").first()
    assert (first.runs_own, first.collapsed, first.strongest.length) == (7, "w", 30)
    assert periodic.with_repeats(docs.withColumn("doc_id", docs.runs)).columns == [*docs.columns, "doc_id"]
    assert periodic.searched(docs.limit(0)).count() == 0
