import hashlib
import random
import re

import numpy as np
import pytest

from lakeshore.llm import pii

NAIVE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0


def naive(text):
    out = []
    for kind, pattern in enumerate(NAIVE):
        for m in pattern.finditer(text):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns_like_naive():
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", ".5", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (949) 555-3739", "+", "12", " ", "-", ".", "é", "foo", "0001.2.3.004", "@@", "a@b.c@d.e", "%", "(", "\n", "99", "+49-30-1234567"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == naive(text), text


def test_long_runs_stay_quick():
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(300):
        t = [word() for _ in range(40)]
        if k % 3 == 0:
            t[7], t[30] = f"user{k}.{word()}@host{k}.example.com", f"user{k}.xyzw"
        if k % 3 == 1:
            t[5] = f"10.0.{k % 200}.7"
        if k % 4 == 0:
            t[9] = f"+1 ({200 + k}) 555-{1000 + k}"
        t[20] = str(rng.randrange(99))
        rows.append((k, " ".join(t), "x"))
    return spark.createDataFrame(rows + [(None, None, "x"), (500, "", "x"), (501, "no digits", "x")], "doc_id long, text string, base_note string")


def test_base_spans_stay_and_repeats_run(spark, docs):
    model = pii.fitted(docs)
    rows = pii.found_in(docs, model).collect()
    assert len(rows) == 303
    for r in rows:
        base = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base]
        assert base == naive(r.text or "")
        for s in r.added:
            assert all(s.end <= a or s.start >= b for _, a, b in base)
    clean = [r for r in rows if not r.base]
    assert all(not r.added for r in clean)


def built(same=0.97, like=0.9):
    """A model by hand: addresses look like themselves, a match is evidence of its kind, links agree."""
    model = pii.Model()
    model.trained = True
    model.look[0, 0], model.look[9, 1] = 4.0, 9.0
    for k in range(len(pii.KINDS)):
        model.look[pii.LOOKS + k, k + 1], model.context[k, k + 1] = 8.0, 4.0
    none = np.zeros(0, int)
    model.same, model.like = pii._given(none, none, none, same), pii._given(none, none, none, like)
    return model


def test_similar_tokens_share_labels():
    text = "mail anna.b@host.org now; later anna.b answered and bob did not"
    (span,) = built(like=0.999).added(text, pii.base_spans(text))
    assert text[span[1] : span[2]] == "anna.b" and span[0] == 0
    assert built(like=0.999).added("anna.b alone", []) == []
    assert built(like=0.999).added(text, pii.base_spans(text), linked=False) == []


def test_texts_without_matches_get_marginals():
    model = built(same=0.999)
    text = "ask user@localhost, not 99"
    assert pii.base_spans(text) == []
    assert model.added(text, []) == [(0, 4, 18)]
    assert model.added(text + " or 10.0.0.7", pii.base_spans(text + " or 10.0.0.7")) == [(0, 4, 18)]
    model.look[9, 1] = 5.0  # 0.7 at best: not sure
    assert model.added(text, []) == []
    assert model.added("", []) == model.added("no suspects", []) == []


@pytest.mark.parametrize("n", [5, 50, 5000])
@pytest.mark.parametrize("between", [" and so on ", " 12, ", " "])
def test_evidence_reaches_every_mention(n, between):
    """One match at the last of many mentions labels all of them; without links it labels none."""
    number = "4845168114407329"
    text = between.join([number + "x"] * n) + " and " + number + "x"
    at = text.rindex(number)
    field = pii.Field(text, [(2, at, at + 16)])
    own = [i for i, name in enumerate(field.names) if name == number + "x"]
    assert len(own) == n + 1
    p = built().marginals(field)[0]
    assert p[own, 3].min() > 0.9 and np.ptp(p[own[:-1], 3]) < 0.05
    assert built().marginals(field.apart())[0][own[:-1], 3].max() < 0.2
    assert built().marginals(pii.Field(text, []))[0][own, 0].min() > 0.8  # the match makes the difference


def test_one_letter_and_one_digit_are_linked():
    text = "7 then 7 and a@b.co met a"
    field = pii.Field(text, pii.base_spans(text))
    assert field.names == ["7", "7", "a@b.co", "a"]
    assert field.form[0] == field.form[1] and len(field.member) == 2


def test_numbers_written_otherwise_share_a_part():
    text = "call +1 (826) 555-4081 or 826-555-4081, not 555-0000"
    field = pii.Field(text, pii.base_spans(text))
    assert {field.written[f] for f in field.member} == {"555-4081", "826-555-4081"}
    p = built(like=0.99).marginals(field)[0]
    by_name = dict(zip(field.names, p[:, 4]))
    assert by_name["826-555-4081"] > 0.6 and by_name["555-0000"] < 0.2


def test_short_parts_of_a_match_are_no_evidence():
    text = "call +1 (826) 555-4081 and take +1 more"
    field = pii.Field(text, pii.base_spans(text))
    assert field.hints.tolist() == [3, 3, 3, -1] and field.bears.tolist() == [False, False, True, False]
    assert built().added(text, pii.base_spans(text)) == []


def test_names_of_values():
    assert pii.assigned_to('api_key: "x', 10) == "api_key" and pii.assigned_to("a = b", 4) == "a"
    assert pii.assigned_to('"my.token"   =   "x', 18) == "my.token" and pii.assigned_to("plain x", 6) is None and pii.assigned_to("= x", 2) is None
    assert pii.assigned_to("n" * 300 + "=x", 301) == "n" * 300
    assert pii.assigned_to("x", 0) is None and pii.assigned_to("", 0) is None


def test_parts_of_addresses_of_any_length():
    text = "0" * 5000 + ".1.2.3 and 1.2.3." + "0" * 6000 + "255 not 1.2.3." + "9" * 5000
    assert [(k, b - a) for k, a, b in pii.base_spans(text)] == [(1, 5006), (1, 6009)]
    assert built().added(text, pii.base_spans(text)) == []


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "write a@b.co or 1.2.3.4é", 5), (2, None, 1), (3, "plain", 1)], "doc_id long, text string, base int")
    assert [r.text for r in sorted(pii.redacted(docs.drop("base"), pii.Model()).collect())] == ["write <email> or <ip>é", None, "plain"]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.found_in(none, pii.fitted(none)).collect() == []


def test_digest_form():
    assert pii.spans_text([(2, 4, 9), (0, 1, 3)]) == "email:1:3,card:4:9"
    assert hashlib.sha256(pii.spans_text([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def random_model(seed, strength=0.5):
    rng = np.random.default_rng(seed)
    model = pii.Model()
    model.trained = True
    for name in ("look", "context", "near", "same", "like"):
        setattr(model, name, rng.normal(0, strength, getattr(model, name).shape))
    return model


def summed_over_labellings(model, field):
    """Marginals of mentions, forms and parts by a sum over all of their labellings, a variable at a time."""
    mention, form = field.around() @ model.context, field.forms() @ model.look
    parts = int(field.group.max(initial=-1)) + 1
    n, f = len(mention), len(form)
    factors = [((i,), mention[i]) for i in range(n)] + [((n + k,), form[k]) for k in range(f)]
    factors += [((i, j), model.near) for i, j in field.links] + [((i, n + field.form[i]), model.same) for i in range(n)]
    factors += [((n + m, n + f + g), model.like) for m, g in zip(field.member, field.group)]
    total = n + f + parts
    args = [x for scope, table in factors for x in (np.exp(table), list(scope))]
    p = [np.einsum(*args, [k], optimize="greedy") for k in range(total)]
    p = [x / x.sum() for x in p]
    return np.array(p[:n]), np.array(p[n : n + f]), np.array(p[n + f :]).reshape(parts, pii.LABELS)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("text", ["a1", "a1 b22", "a1 b22 c333 plain d4 +e5", "1 2 3 4 5 6 7", "mail x@y.org now 12-34 (5)", "7 or 7", "x@y.org, so 12-34 x"])
def test_marginals_of_trees_are_exact(seed, text):
    model, field = random_model(seed), pii.Field(text, pii.base_spans(text))
    for got, want in zip(model.marginals(field), summed_over_labellings(model, field)):
        assert got.shape == want.shape and np.abs(got - want).max(initial=0) < 1e-3


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("text", ["7 7", "7 8 7", "7 8 7 8", "1 x 1 2 1 y 2", "a@b.co c@b.co b.co", "+12 12 (12) 7"])
def test_marginals_of_loops_are_near(seed, text):
    """Repeats make loops: messages come near to the sum over all labellings, and nearer than without the links."""
    model, field = random_model(seed, 0.7), pii.Field(text, pii.base_spans(text))
    assert len(field.nodes) <= 8 and (len(field.member) or len(field.written) < len(field.nodes))
    want = summed_over_labellings(model, field)
    for got, exact in zip(model.marginals(field), want):
        assert np.abs(got - exact).max(initial=0) < 0.05
    unlinked = model.marginals(field.apart())[0]
    assert np.abs(model.marginals(field)[0] - want[0]).max() < np.abs(unlinked - want[0]).max()


def test_links_change_what_is_added(spark):
    """Learned on texts where some mentions of a number have a match and others, run into a neighbour, don't."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(c for c in iter(lambda: digits(16), "") if pii.luhn(c))
    rows = [f"text {k} pays {(c := card())} on day {k % 28}, then {c} again or {digits(16)} in {k % 7} parts" for k in range(300)]
    model = pii.fitted(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    fails = next(c for c in iter(lambda: digits(16), "") if not pii.luhn(c))
    known = card()
    text = f"pay {known} now; later {fails} {known} once more"
    spans = pii.base_spans(text)
    assert pii.spans_text(spans) == "card:4:20"
    at = text.rindex(known)
    assert (2, at, at + 16) in model.added(text, spans)


def test_long_texts_of_numbers_with_a_trained_model(spark, docs):
    model = pii.fitted(docs)
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(5000)) for _ in range(100_000)) + " mail me.too@host.org or me.too@host.org"
    spans = pii.base_spans(text)
    assert model.added(text, spans) == [] and len(spans) == 2


def test_adds_what_patterns_drop(spark):
    """A phone number that runs into an address, two cards in a row, secrets and their repeats; not numbers that fail the check."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    card = lambda: next(c for c in iter(lambda: digits(16), "") if pii.luhn(c))
    fails = lambda: next(c for c in iter(lambda: digits(16), "") if not pii.luhn(c))
    rows = []
    for k in range(300):
        rows.append(f"text {k} of +1 ({digits(3)}) 555-{digits(4)} and mail{k}@host.org at 10.{k % 200}.7.9 with {card()} or {fails()} version {k % 9}. ok")
        rows.append(f'set token = "{hexes()}" then {fails()} item {k}, no. {k % 7} end')
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = pii.fitted(docs)
    added = lambda text: pii.spans_text(model.added(text, pii.base_spans(text)))
    assert added("call +1 (826) 555-4081 190.137.223.204 now") == "phone:5:22"
    secret = hexes()
    text = f'api_key: "{secret}" and again {secret} here'
    assert added(text) == f"secret:{text.index(secret)}:{text.index(secret) + 40},secret:{text.rindex(secret)}:{text.rindex(secret) + 40}"
    a, b = card(), card()
    assert added(f"pay {a} {b} soon") == "card:4:20,card:21:37"
    assert added(f"number {fails()} is no card, version 2.0. and 7") == ""
