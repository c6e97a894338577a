import random
import re

import pytest

from lakeshore.llm import decontamination as deco


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(text, items):
    words = naive_words(text)
    hit, found = set(), set()
    for item, other in items:
        w = naive_words(other)
        n = min(10, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def corpus():
    rng = random.Random(8)
    word = lambda n=30: f"{rng.choice(['ab', 'É', 'ñ7', 'x'])}{rng.randrange(n)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 40)))) for k in range(30)]
    items += [(90, "solo"), (91, ""), (92, None), (93, items[0][1]), (None, items[1][1]), (94, "a a a a a a a a a a a a a"), (95, "two words"), (96, "b a a a")]
    docs = []
    for k in range(150):
        t = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            t[rng.randrange(len(t) + 1) : 0] = w[a : a + rng.randrange(4, 30)]
        text = " ".join(t)
        docs.append((k, text.upper().replace(" ", rng.choice([" ", ", ", "\n"]))))
    return docs + [(None, None), (200, ""), (201, "solo Two, words"), (202, "a " * 30), (202, "solo")], items


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_like_brute_force(spark, block_words):
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = deco.contamination(frame, bench, block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.leak.n_words, r.leak.n_hit, list(r.leak.items)) == brute_force(r.text, items)


def test_spans_go(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it, {passage.upper()}; after it and more words to stay here now yes indeed so", "en", "s", 5), (2, passage, "en", "s", 5), (3, "clean text é", None, None, 12), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = sorted(deco.decontaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect())
    assert [r.doc_id for r in rows] == [1, 3, 4]
    assert rows[0].text == "Before it, ; after it and more words to stay here now yes indeed so" and rows[0].n_chars == len(rows[0].text)
    assert (rows[1].text, rows[1].n_chars, rows[2].text) == ("clean text é", 12, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words É here"), (2, None)], "doc_id long, text string")
    assert [(r.leak.n_words, r.leak.n_hit) for r in sorted(deco.contamination(docs, none).collect())] == [(4, 0), (0, 0)]
    assert deco.contamination(docs.filter("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
