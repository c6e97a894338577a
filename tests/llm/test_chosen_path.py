import random

import numpy as np
import pyarrow as pa
import pytest

from lakeshore.llm import chosen_path
from lakeshore.llm.components import components


def brute_force(rows):
    sets = []
    for _, text, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((str(r[0]), len(s), str(None if r[0] is None else find(r[0])), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets))


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(30)]
    base = [word() for _ in range(90)]
    texts = []
    for k in range(40):  # near copies at many distances of a common text
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(90)] = word()
        texts.append(" ".join(own))
    for k in range(25):  # further apart than the threshold, mostly
        own = list(base)
        for _ in range(rng.randrange(3, 30)):
            own[rng.randrange(90)] = word()
        texts.append(" ".join(own))
    for k in range(35):  # a passage that many share
        texts.append(" ".join([word() for _ in range(rng.randrange(5, 60))] + shared))
    chain = [word() for _ in range(60)]
    for k in range(15):  # each a little further from the one before
        chain[(7 * k) % 60] = word()
        texts.append(" ".join(chain).upper() if k % 2 else " ".join(chain))
    texts += [None, "", " \n", "one two", "One  Two", "one two three", "x " * 400, "x " * 300, base and " ".join(base), " ".join(base)]
    rng.shuffle(texts)
    return [(3 * k + 1, t, "s", 1) for k, t in enumerate(texts)] + [(4, texts[1], "s", 2), (None, texts[0], "s", 3)]


@pytest.mark.parametrize("leaf, node_rows, held", [(64, 20_000, 1 << 21), (4, 20_000, 300), (4, 12, 1 << 21)])
def test_like_brute_force(spark, monkeypatch, leaf, node_rows, held):
    """Also with leaves, nodes and held sets so small that all ways are taken."""
    for name, value in (("LEAF", leaf), ("NODE_ROWS", node_rows), ("HELD_SHINGLES", held)):
        monkeypatch.setattr(chosen_path, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, rep int")
    got = chosen_path.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_force(rows)


def node_table(sets, labels=None, node=0):
    """One node of the classes with these shingle sets."""
    n = len(sets)
    columns = [np.full(n, node), np.arange(n), np.array(list(map(len, sets))), np.arange(n) if labels is None else labels]
    return pa.table(dict(zip(chosen_path.NODE_COLUMNS, [*map(pa.array, columns), pa.array([chosen_path.sketch(np.sort(s)).tobytes() for s in sets])])))


def drawn(rng, n):
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def test_sketches_find_links_and_part_the_rest():
    rng = np.random.default_rng(3)
    for n in (6, 40, 400, 4000):
        common = drawn(rng, n * 6 // 7)
        sets = [np.concatenate((common, drawn(rng, n - len(common)))) for _ in range(60)]  # 0.75 alike
        x = chosen_path.Nodes(node_table(sets), True, 64)
        list(x.search())
        assert x.n_pairs == 60 * 59 // 2
    common = drawn(rng, 280)
    sets = [np.concatenate((common, drawn(rng, 120))) for _ in range(60)]  # 0.54 alike
    x = chosen_path.Nodes(node_table(sets), True, 64)
    list(x.search())
    assert x.n_pairs < 60


def test_templates_cost_no_square(spark, monkeypatch):
    """Documents of one template, 0.52 alike: nothing links them, and rows grow with their number only."""
    rng = np.random.default_rng(4)
    common = drawn(rng, 274)
    compared = {500: 0, 2000: 0}
    for n in compared:
        sets = [np.concatenate((common, drawn(rng, 126))) for _ in range(n)]
        for node in range(6):
            x = chosen_path.Nodes(node_table(sets, np.arange(n), node), True, 64)
            inner = x._may_link

            def counted(a, b, n=n, inner=inner):
                compared[n] += len(a)
                return inner(a, b)

            x._may_link = counted
            list(x.search())
            assert x.n_pairs < n // 4
    assert compared[2000] < 12 * compared[500] and compared[2000] < 6 * 2000 * 1999 // 4
    word = lambda: f"w{rng.integers(1 << 40)}"
    template = [word() for _ in range(68)]
    texts = [" ".join([*template, *(word() for _ in range(32))]) for _ in range(2000)]  # 64 of 128 shingles shared
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = []
    group = chosen_path.groups_within
    monkeypatch.setattr(chosen_path, "groups_within", lambda nodes: rows.append(group(nodes).count()) or group(nodes))
    assert chosen_path.near_duplicates(docs).filter("kept").count() == 2000
    assert rows[0] < 2000


def test_links_across_a_large_group():
    """One text is linked only with some members of a group of thousands, which all have one label already."""
    rng = np.random.default_rng(6)
    base = drawn(rng, 400)
    sets = [np.concatenate((base[:380], drawn(rng, 20))) for _ in range(3000)]
    far = [np.concatenate((s[40:], drawn(rng, 40))) for s in sets[:100]]  # 0.82 like its own one, less like the others
    labels = np.concatenate((np.zeros(3000, np.int64), np.arange(3000, 3100)))
    x = chosen_path.Nodes(node_table(sets + far, labels), True, 64)
    list(x.search())
    found = {frozenset((a, b)) for held, others in x.groups for a in x.rep[held].tolist() for b in x.rep[np.concatenate((held, others))].tolist()}
    assert sum(frozenset((k, 3000 + k)) in found for k in range(100)) >= 60  # of one tree, whose chance is 0.89 a pair at the threshold


@pytest.mark.parametrize("common, own", [(380, 20), (370, 30), (345, 55)])
def test_changed_copies_join_their_original_without_all_pairs(common, own):
    """Copies with changes of their own, 0.90, 0.86 and 0.76 alike their original and 0.61 at least alike each other."""
    rng = np.random.default_rng(own)
    base = drawn(rng, common + own)
    sets = [np.concatenate((base[rng.permutation(common + own)[:common]], drawn(rng, own))) for _ in range(3000)]
    x = chosen_path.Nodes(node_table([*sets, base]), False, 64)
    compared = [0]
    inner = x._may_link

    def counted(a, b):
        compared[0] += len(a)
        return inner(a, b)

    x._may_link = counted
    list(x.search())
    a, b = x.forest()
    hub = sum(3000 in pair for pair in zip(a.tolist(), b.tolist()))
    assert compared[0] < 400 * 3000 and len(a) == 3000 and hub > 2900


def test_spanning_connects_what_pairs_connect():
    rng = np.random.default_rng(8)
    for n in (2, 30, 300):
        u, v = rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n)
        kept, root = chosen_path.spanning(u, v, n)
        least = np.arange(n)
        for _ in range(n):
            np.minimum.at(least, u, least[v])
            np.minimum.at(least, v, least[u])
        assert (root == least).all() and len(kept) == n - len(set(least.tolist()))


def test_deduplicated_keeps_one_each(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, rep int")
    kept = chosen_path.deduplicated(docs)
    assert kept.columns == docs.columns
    expected = {r[0] for r in brute_force(rows) if r[3]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(expected)


def test_empty(spark):
    assert chosen_path.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (205, 201), (203, 205)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 201: 201, 203: 201, 205: 201}
