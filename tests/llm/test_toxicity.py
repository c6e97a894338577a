import random
import re

from lakeshore.llm import toxicity


def symbols(text, stems):
    return [dict(c) for c in toxicity.clauses(text, toxicity.Lexicon(stems))]


def test_grammar_marks_clauses():
    stems = {"idiot$": 1.0, "scum": 2.0}
    assert symbols("an idiot", stems) == [{("insult",): 1.0}]
    assert symbols("you are an idiot", stems) == [{("insult", "aimed"): 1.0}]
    assert symbols("he is not an idiot", stems) == [{("insult", "negated", "aimed"): 1.0}]
    assert symbols("not now. an idiot", stems) == [{("insult",): 1.0}]
    assert symbols("never do it again idiot", stems) == [{("insult",): 1.0}]  # out of the negation's reach
    assert symbols("the paper said that some idiot came", stems) == [{("insult", "reported"): 1.0}]
    assert symbols("such an idiot; such idiot scum", stems) == [{("insult",): 1.0}, {("insult", "strong"): 3.0}]
    assert symbols("i will kill you; scummy idiots", stems) == [{("threat",): 1.0, ("threat", "strong"): 1.0}, {("insult",): 2.0}]
    assert symbols("they kill time", stems) == [] == symbols("to hurt", stems)  # a verb alone is no threat
    assert symbols("never hurt them", stems) == [{("threat", "negated", "strong"): 1.0}]


def by_hand(text, lexicon):
    """A second reading of the grammar: each word's marks from the words before it, without transducers."""
    out = []
    for clause in re.split(r"[.!?;:|\n]", text):
        words = list(toxicity.tokens(clause, lexicon))
        kinds = [lexicon.of(w) for w in words]
        found = {}

        def near(k, kind, reach):
            return any(kinds[j][0] == kind for j in range(max(0, k - reach), k))

        def marks(k):
            return (*(["negated"] if near(k, "negation", 3) else []), *(["aimed"] if near(k, "target", 4) else []), *(["reported"] if near(k, "report", k) else []))

        open_verb = None
        for k, (kind, weight) in enumerate(kinds):
            hit = None
            if kind == "insult":
                strong = k > 0 and kinds[k - 1][0] in ("insult", "booster")
                hit = ("insult", *marks(k), *(["strong"] if strong else []))
            elif kind == "threat":
                hit = ("threat", *marks(k)) if near(k, "intent", 4) else None
                open_verb = k
            elif kind == "target" and open_verb is not None and k - open_verb <= 3:
                hit, open_verb = ("threat", *marks(open_verb), "strong"), None
            if hit:
                found[hit] = found.get(hit, 0.0) + (weight or 1.0)
        if found:
            out.append(found)
    return out


def test_like_a_reading_by_hand():
    rng = random.Random(12)
    lexicon = toxicity.Lexicon({"idiot$": 1.0, "scum": 2.0})
    some = ["idiot", "scummy", "kill", "hurt", "you", "them", "not", "never", "said", "will", "going", "such", "very", "word", "other", "x", ".", ";"]
    seen = set()
    for _ in range(4000):
        text = " ".join(rng.choice(some) for _ in range(rng.randrange(14)))
        got = [dict(c) for c in toxicity.clauses(text, lexicon)]
        assert got == by_hand(text, lexicon), text
        seen |= {k for c in got for k in c}
    assert seen >= {k for k in toxicity.KINDS if len(k) < 4}


def test_learns_stems_and_leaves_clean_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "lo", "ti", "mu"]) for _ in range(3))
    rows, labels = [], []
    for k in range(600):
        t, toxic = [word() for _ in range(40)], k % 5 == 0
        if toxic:
            for _ in range(4):
                t[rng.randrange(40)] = rng.choice(["vermin", "zork" + word()])
        rows.append((k, " ".join(t), 1))
        labels += [(k, int(toxic))] * (1 + (k % 7 == 0))
    docs = spark.createDataFrame(rows + [(None, None, 1), (900, "", 1)], "doc_id long, text string, score int")
    known = spark.createDataFrame(labels + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int").filter("doc_id is null or doc_id % 3 != 1")
    model = toxicity.fitted(docs, known)
    assert set(model.lexicon.stems) == {"vermin$", "zork"}
    plain = docs.drop("score")
    out = {r.doc_id: r for r in toxicity.scored(plain, model).collect()}
    assert len(out) == 602
    wrong = [k for k in range(600) if out[k].predicted != int(k % 5 == 0)]
    assert not wrong and all(0 <= r.score <= 1 for r in out.values())
    assert out[None].predicted == 0 and out[900].score == out[None].score
    kept = toxicity.cleaned(plain, model)
    assert kept.columns == plain.columns and kept.count() == 602 - 120


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "I will kill you"), (2, "hello")], "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in sorted(toxicity.scored(docs, model).collect())] == sorted([model.score("I will kill you"), model.score("hello")], reverse=True)
    assert toxicity.scored(docs.filter("false"), model).collect() == []


def test_elided_words_are_read_as_they_are_learned(spark):
    lexicon = toxicity.Lexicon({"idiot$": 1.0, "crétin": 2.0})
    read = lambda text: list(toxicity.tokens(text, lexicon))
    assert read("l'idiot, l’idiot. isn't isn’t i'll o'clock") == ["l", "idiot", "l", "idiot", ".", "isn't", "isn't", "i'll", "o", "clock"]
    model = toxicity.Model({"idiot$": 1.0, "crétin": 2.0}, toxicity.PRIOR)
    base = model.score("")
    for text in ("espèce d'idiot", "l'idiot", "L’IDIOT", "crétin's", "rock'n'idiot"):
        assert model.score(text) > 2 * base, text
    assert symbols("he isn't an idiot", {"idiot$": 1.0}) == symbols("he is not idiot", {"idiot$": 1.0})
    rows = [(k, f"texte {k} " + ("avec l'abruti là" if k % 4 == 0 else "sans mot grave"), int(k % 4 == 0)) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    learned = toxicity.fitted(docs, spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int"))
    assert learned.score("un d'abruti") >= toxicity.REJECT > learned.score("un dabruti")
