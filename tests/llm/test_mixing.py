import pytest

from lakeshore.llm import mixing


def filled(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        per = left / sum(weight[k] for k in free)
        above = [k for k in free if per * weight[k] >= most * sizes[k]]
        if not above:
            return out | {k: per * weight[k] for k in free}
        for k in above:
            out[k] = most * sizes[k]
            left -= out[k]
            free.remove(k)
    return out


def test_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), ["b", "a", None, "B", "é"][(i * i) % 5 if i % 3 else 0], 9) for i in range(400)]
    rows += [(None, "null id", "a", 1), (7, None, "a", 1), (7, "", None, 1), (8, "x y", "b", 1), (8, "x y", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_class int")
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goal = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert 0 <= r.mix_copies <= 2
        assert r.mix_target == pytest.approx(goal[r.source]) and r.mix_source_size == sizes[r.source]
        taken[r.source] += r.mix_copies * r.mix_size
    for k in sizes:
        assert abs(taken[k] - goal[k]) <= 16 + 0.02 * goal[k]
    again = mixing.mixed(docs.repartition(3)).collect()
    key = lambda x: sorted((str(r.doc_id), str(r.text), str(r.source), r.mix_copies) for r in x)
    assert key(out) == key(again)
    assert mixing.emitted(docs).count() == sum(r.mix_copies for r in out)
    assert mixing.emitted(docs).columns == docs.columns


def test_empty_and_blank(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], kind)).collect() == []
    (row,) = mixing.mixed(spark.createDataFrame([(1, None, None)], kind)).collect()
    assert (row.mix_size, row.mix_target, row.mix_copies) == (0, 0.0, 0)
