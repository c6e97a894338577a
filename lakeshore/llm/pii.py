"""Personal data: fixed patterns, then a skip-chain conditional random field that adds what their tokens imply.

The field's mentions are a text's suspect tokens: those with a digit, an at sign or a plus sign, and those that equal a part of such a
token (an address's name or host). Neighbouring mentions share a transition potential. All mentions of one form, however distant, share a
potential with that form's entity, and forms that share a part (a name, a host, the same digits written otherwise) with the entity
of that part, so labels agree all over a document. How a token looks, and whether a pattern found any of its mentions, is known of the form and
counts once; what stands around a mention (its own match, a name it is assigned to, its neighbours) is its own. A mention without
anything of that kind says nothing, so evidence at one mention reaches the others undiluted however many there are. Loopy sum-product
message passing gives each mention's marginal label; a token adds a span where its best label is no plain text, has at least
SURE marginal, no pattern covers it, and it has as many digits as its kind can have. Secrets have no pattern: they are learned from long mixed tokens assigned to a secret's name.
Tokens that aren't suspect have nothing that could label them, so they are left out of the field.

Potentials are learned piece by piece by pseudo-likelihood, from the patterns' own matches: looks first, with the matches hidden from a
part of the mentions; then surroundings; then what links add to both. The sample is bounded: about SAMPLE_ROWS texts with suspects,
chosen by a hash of the text, and SAMPLE_MENTIONS mentions of each.

Cases: a null text is empty; texts without suspects have no spans; texts without a pattern's match are searched by the field
like all others; without training texts only patterns find spans; equal tokens are linked whatever their length; groups of any size share an
entity, never pair by pair, in time and memory linear in their size; repeated rows are searched alike; an empty table
gives an empty table; other columns stay, those named base or added as base_own and added_own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.shared import numbered, set_aside, widened

KINDS = ("email", "ip", "card", "phone")
#: What the field can label: the patterns' kinds, and secrets, which no pattern finds. Plain text is 0, these from 1 on.
LABELLED = (*KINDS, "secret")
#: Bounds on the training sample: about so many texts with suspects, and mentions of each.
SAMPLE_ROWS, SAMPLE_MENTIONS = 3000, 2000
#: Digits that a card and a phone number can have: runs of other sizes are neither, however sure their tokens are.
SIZES = {2: (13, 19), 3: (7, 15)}
SURE, ROUNDS, DAMP = 0.9, 12, 0.3
HIDDEN = 0.3
#: Prior chances that a mention has its form's label, and a form that of a part it shares.
AGREE, ALIKE = 0.95, 0.7
#: Rows of messages computed at a time.
SLICE = 1 << 15

# The patterns. Possessive and anchored where that only saves retries.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SUSPECT = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"[^\s,;:!?\"'<>|=]+")
#: Words in names of secrets.
SECRET_NAMES = ("token", "secret", "key", "passw", "pwd", "auth", "credential")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """Whether digits, however many zeros lead them, are at most 255."""
    left = part.lstrip("0")
    return len(left) <= 3 and int(left or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns' valid matches, by kind, then start."""
    out: list[Span] = []
    if not SUSPECT.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(end, at + 1))
    out += [(1, *m.span()) for m in IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


#: Features of a form (how it looks, then the kind of the pattern that found one of its mentions), and of what is around a mention (the
#: kind of its own match, assigned to a name, assigned to a secret's name).
LOOKS = 23
FORM, AROUND = LOOKS + len(KINDS), len(KINDS) + 2
LABELS = len(LABELLED) + 1


def looks(token: str) -> list[float]:
    d = _digits(token)
    parts = token.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    mixed = len(token) >= 16 and 0 < len(d) < len(token)
    size = [0.0] * 8
    size[min(7, (len(d) + 1) // 2)] = 1.0
    return [
        1.0, *size, "@" in token, "@" in token and "." in token.rpartition("@")[2], token.startswith("+"), "(" in token or ")" in token,
        four, four and all(_octet(p) for p in parts), 13 <= len(d) <= 19 and luhn(d), any(c.isalpha() for c in token), len(d) == len(token), "-" in token, not d,
        mixed, mixed and all(c in "0123456789abcdefABCDEF" for c in token), mixed and sum((a in "0123456789") != (b in "0123456789") for a, b in zip(token, token[1:])) >= 4,
    ]


def assigned_to(text: str, start: int) -> str | None:
    """The name that what starts here is assigned to, as in ``name = "`` or ``name: ``; None if there is none."""
    at = start - (start > 0 and text[start - 1] in "\"'")
    while at > 0 and text[at - 1].isspace():
        at -= 1
    if not at or text[at - 1] not in "=:":
        return None
    at -= 1
    while at > 0 and text[at - 1].isspace():
        at -= 1
    end = at = at - (at > 0 and text[at - 1] in "\"'")
    while at > 0 and text[at - 1] in NAME_CHARS:
        at -= 1
    name = text[at:end].lstrip("0123456789_.-")
    return name or None


def _bare(token: str) -> str:
    return token.strip(".-()").lower()


def _parts(token: str) -> list[str]:
    """What a similar token may share: an address's name and host, a number's digits."""
    if "@" in token:
        name, _, host = token.lower().rpartition("@")
        return [p for p in (_bare(name), _bare(host)) if p]
    d = _digits(token)
    return [d] if d and d != token else []


class Field:
    """A text's graph: mentions, links (i, j) of neighbours, the form of each mention, and (form, part) memberships."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        suspect = [k for k, (a, b) in enumerate(tokens) if SUSPECT.search(text, a, b)]
        wanted = {p for k in suspect for p in _parts(text[slice(*tokens[k])])}
        taken = set(suspect)
        if wanted:
            taken |= {k for k, (a, b) in enumerate(tokens) if _bare(text[a:b]) in wanted}
        order = sorted(taken)
        self.nodes = [tokens[k] for k in order]
        self.names = [text[a:b] for a, b in self.nodes]
        at = {k: i for i, k in enumerate(order)}
        self.links = [(i, at[k + 1]) for i, k in enumerate(order) if k + 1 in at]
        names = [assigned_to(text, a) for a, _ in self.nodes]
        self.assigned = np.array([0 if n is None else 1 + any(w in n.lower() for w in SECRET_NAMES) for n in names], int)
        known: dict[str, int] = {}
        self.form = np.array([known.setdefault(_bare(n), len(known)) for n in self.names], int)
        first = np.unique(self.form, return_index=True)[1] if len(self.form) else []
        self.written = [self.names[i] for i in first]
        self.hints, self.bears = np.full(len(self.nodes), -1), np.zeros(len(self.nodes), bool)
        parts: dict[str, dict[int, None]] = {}
        starts = [a for a, _ in self.nodes]
        for kind, a, b in spans:
            size = sum(c.isalnum() for c in text[a:b])
            for i in range(max(0, int(np.searchsorted(starts, a, "left")) - 1), len(self.nodes)):
                x, y = self.nodes[i]
                if x >= b:
                    break
                if y > a:
                    self.hints[i] = kind
                    # a short part of a match, such as a country's number, is no evidence where it stands elsewhere
                    self.bears[i] = 2 * sum(c.isalnum() for c in text[max(a, x) : min(b, y)]) >= size
                    if self.bears[i] and kind > 1:
                        d = _digits(text[a:b])
                        for key in {d, d[-10:]} if kind == 3 else {d}:
                            parts.setdefault(key, {})[int(self.form[i])] = None
        for bare, f in known.items():
            for key in {bare, *_parts(self.written[f])}:
                parts.setdefault(key, {})[f] = None
        groups = sorted({tuple(sorted(forms)) for forms in parts.values() if len(forms) > 1})
        self.member = np.array([f for group in groups for f in group], int)
        self.group = np.repeat(np.arange(len(groups)), [len(group) for group in groups]).astype(int)

    def apart(self) -> Field:
        """The same mentions without links between distant ones: each its own form, no parts. For measuring what links do."""
        out = object.__new__(Field)
        out.__dict__ = self.__dict__ | {"form": np.arange(len(self.nodes)), "written": self.names, "member": np.zeros(0, int), "group": np.zeros(0, int)}
        return out

    def around(self, hidden: np.ndarray | None = None) -> np.ndarray:
        hints = self.hints if hidden is None else np.where(hidden, -1, self.hints)
        x = np.zeros((len(hints), AROUND), np.float32)
        x[hints >= 0, hints[hints >= 0]] = 1
        x[:, -2], x[:, -1] = self.assigned > 0, self.assigned > 1
        return x

    def forms(self, hidden: np.ndarray | None = None) -> np.ndarray:
        """Looks of each form, and the kind that most of its mentions with evidence are (the first of equally many)."""
        shown = self.bears if hidden is None else self.bears & ~hidden
        counts = np.zeros((len(self.written), len(KINDS)))
        np.add.at(counts, (self.form[shown], self.hints[shown]), 1)
        x = np.zeros((len(self.written), FORM), np.float32)
        if len(self.written):
            x[:, :LOOKS] = [looks(w) for w in self.written]
            some = np.flatnonzero(counts.any(axis=1))
            x[some, LOOKS + counts[some].argmax(axis=1)] = 1
        return x

    def truth(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels to learn from, of mentions, forms and parts: the patterns' kinds; long mixed tokens assigned to a secret's name; a form or
        part is what most of its labelled members are, plain if none is."""
        seed = np.array([a == 2 and len(n) >= 16 and 0 < len(_digits(n)) < len(n) for n, a in zip(self.names, self.assigned)], bool)
        own = np.where(self.hints >= 0, self.hints + 1, np.where(seed, LABELS - 1, 0))
        form = _most(own, self.form, len(self.written))
        return own, form, _most(form[self.member], self.group, int(self.group.max(initial=-1)) + 1)


def _most(labels: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The commonest label but 0 at each place, 0 where there is none."""
    counts = np.zeros((n, LABELS))
    np.add.at(counts, (place, labels), 1)
    counts[:, 0] = 0.5
    return counts.argmax(axis=1)


class Model:
    """Weights of forms and of what is around mentions (features x labels), and label matrices: of neighbours, of a mention and its
    form, of a form and its part. Label 0 is plain text."""

    def __init__(self) -> None:
        self.look, self.near = np.zeros((FORM, LABELS)), np.zeros((LABELS, LABELS))
        self.context, none = np.zeros((AROUND, LABELS)), np.zeros(0, int)
        self.same, self.like = _given(none, none, none, AGREE), _given(none, none, none, ALIKE)
        self.trained = False

    def marginals(self, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of mentions, forms and parts: loopy sum-product for ROUNDS rounds, messages damped. Exact where the graph has no loop and no
        longer path than ROUNDS."""
        mention, form = (field.around() @ self.context).astype(np.float32), (field.forms() @ self.look).astype(np.float32)
        n, forms, parts = len(mention), len(form), int(field.group.max(initial=-1)) + 1
        links = np.array(field.links, int).reshape(-1, 2)
        zeros = lambda k: np.zeros((k, LABELS), np.float32)
        right, left, down, under = zeros(len(links)), zeros(len(links)), zeros(n), zeros(len(field.member))
        for _ in range(ROUNDS):
            near = _summed(right, links[:, 1], n) + _summed(left, links[:, 0], n)
            up = _sent(mention + near, self.same)
            whole = form + _summed(up, field.form, forms)
            over = _sent((whole + _summed(under, field.member, forms))[field.member] - under, self.like)
            part = _summed(over, field.group, parts)
            new_under = _sent(part[field.group] - over, self.like.T)
            new_down = _sent((whole + _summed(under, field.member, forms))[field.form] - up, self.same.T)
            own = mention + near + down
            new_right = _sent(own[links[:, 0]] - left, self.near)
            new_left = _sent(own[links[:, 1]] - right, self.near.T)
            for old, new in ((under, new_under), (down, new_down), (right, new_right), (left, new_left)):
                old *= DAMP
                old += (1 - DAMP) * new
        near = _summed(right, links[:, 1], n) + _summed(left, links[:, 0], n)
        up = _sent(mention + near, self.same)
        whole = form + _summed(up, field.form, forms) + _summed(under, field.member, forms)
        part = _summed(_sent(whole[field.member] - under, self.like), field.group, parts)
        return _softmax(mention + near + down), _softmax(whole), _softmax(part)

    def added(self, text: str, spans: list[Span], linked: bool = True) -> list[Span]:
        """Spans beside the patterns' ones: runs of neighbouring mentions of one sure label. ``linked``: whether distant mentions share
        entities."""
        if not self.trained:
            return []
        field = Field(text, spans)
        if not field.nodes:
            return []
        p = self.marginals(field if linked else field.apart())[0]
        label = p.argmax(axis=1)
        sure = np.flatnonzero((label > 0) & (p[np.arange(len(p)), label] >= SURE))
        covered = np.array(sorted((a, b) for _, a, b in spans)).reshape(-1, 2)
        furthest = np.maximum.accumulate(covered[:, 1]) if len(covered) else covered[:, 1]
        out: list[Span] = []
        for i in sure.tolist():
            a, b = field.nodes[i]
            before = int(np.searchsorted(covered[:, 0], b, "left"))
            if before and furthest[before - 1] > a:
                continue
            kind = int(label[i]) - 1
            whole = len(_digits(text[a:b])) >= 13 or label[i] == len(LABELLED)  # a card or a secret of its own
            if out and out[-1][0] == kind and not whole and not text[out[-1][2] : a].strip():
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
        return [s for s in out if s[0] not in SIZES or SIZES[s[0]][0] <= len(_digits(text[s[1] : s[2]])) <= SIZES[s[0]][1]]


def _summed(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` summed by their place among ``n``."""
    if not len(x):
        return np.zeros((n, LABELS), np.float32)
    return np.stack([np.bincount(place, x[:, k], n) for k in range(LABELS)], axis=1).astype(np.float32)


def _sent(belief: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages of beliefs (rows) through a potential (from, to), each with a largest value of 0."""
    out = np.empty_like(belief)
    weights = np.exp(potential).astype(np.float32)
    for at in range(0, len(belief), SLICE):
        x = belief[at : at + SLICE]
        # potentials are bounded, so the largest belief is never lost beside others
        y = np.log(np.exp(x - x.max(axis=1, keepdims=True)) @ weights)
        out[at : at + SLICE] = y - y.max(axis=1, keepdims=True)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


def _learned(x: np.ndarray, y: np.ndarray, weight: np.ndarray, given: np.ndarray, prior: np.ndarray, rounds: int) -> np.ndarray:
    """Weights that add to what is ``given``: Adam-like steps on the weighted likelihood, drawn to ``prior``."""
    w, speed, size = prior.copy(), np.zeros_like(prior), np.full_like(prior, 1e-8)
    if not len(x):
        return w
    wanted = np.eye(LABELS)[y]
    weight = weight / weight.sum()
    for _ in range(rounds):
        slope = x.T @ ((wanted - _softmax(given + x @ w)) * weight[:, None]) - 1e-4 * (w - prior)
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        w += 0.1 * speed / np.sqrt(size + 1e-10)
    return w


def _given(cause: np.ndarray, label: np.ndarray, weight: np.ndarray, agree: float) -> np.ndarray:
    """The logarithm of each label's chance (rows) given the label it hangs on (columns), from counts and a prior worth one count. A
    label's chances add to 1, so what is undecided about it sends nothing on."""
    seen = np.full((LABELS, LABELS), (1 - agree) / (LABELS - 1)) + np.eye(LABELS) * (agree - (1 - agree) / (LABELS - 1))
    np.add.at(seen, (label, cause), weight)
    return np.log(seen / seen.sum(axis=0))


#: What a row of the training table describes.
OF_FORM, OF_MENTION, OF_PART = range(3)


def _lessons(text: str) -> Iterator[tuple[int, list[float], int]]:
    """(what, features, label): forms by looks and evidence; mentions by what is around them, labels beside and their form's;
    forms by that and their part's label. Matches are hidden from a share of the mentions."""
    field = Field(text, base_spans(text))
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    hidden = rng.random(len(field.nodes)) < HIDDEN
    own, form, part = field.truth()
    eye = np.eye(LABELS)
    of_form, around = field.forms(hidden), field.around(hidden)
    beside = np.zeros((len(own), LABELS))
    for i, j in field.links:
        beside[i, own[j]] += 1
        beside[j, own[i]] += 1
    few = lambda n: range(n) if n <= SAMPLE_MENTIONS else rng.choice(n, SAMPLE_MENTIONS, replace=False).tolist()
    for f in few(len(form)):
        yield OF_FORM, of_form[f].tolist(), int(form[f])
    for i in few(len(own)):
        yield OF_MENTION, [*around[i].tolist(), *beside[i].tolist(), *eye[form[field.form[i]]].tolist()], int(own[i])
    for m in few(len(field.member)):
        yield OF_PART, [*of_form[field.member[m]].tolist(), *eye[part[field.group[m]]].tolist()], int(form[field.member[m]])


def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 300, text_col: str = "text") -> Model:
    """Learn potentials piece by piece by pseudo-likelihood on a bounded sample of ``docs``."""
    found = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@+]"))
    n = found.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = found.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for text in batch.column(0) for row in _lessons(text.as_py())]
            what, x, y = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["what", "x", "y"])

    # alike rows become one; what comes to the driver is bounded by the sample
    table = sample.mapInArrow(describe, "what int, x array<double>, y int").groupBy("what", "x", "y").count().orderBy("what", "x", "y").toArrow()
    model = Model()
    if not table.num_rows:
        return model
    what, label, count = (table[c].to_numpy() for c in ("what", "y", "count"))
    x_of = lambda k, width: np.array([v for v, w in zip(table["x"].to_pylist(), what) if w == k], float).reshape(-1, width)
    learn = lambda k, x, given, prior: _learned(x, label[what == k], count[what == k].astype(float), given, prior, rounds)
    even = lambda m: (m + m.T) / 2
    forms, mentions, parts = x_of(OF_FORM, FORM), x_of(OF_MENTION, AROUND + 2 * LABELS), x_of(OF_PART, FORM + LABELS)
    model.look = learn(OF_FORM, forms, np.zeros((len(forms), LABELS)), np.zeros((FORM, LABELS)))
    # what is around a mention, before its form is known: else the form, which has the true label here, would leave nothing to it
    around, by_form = mentions[:, : AROUND + LABELS], mentions[:, AROUND + LABELS :]
    own = learn(OF_MENTION, around, np.zeros((len(mentions), LABELS)), np.zeros((AROUND + LABELS, LABELS)))
    model.context, model.near = own[:AROUND], even(own[AROUND:])
    free = ~around[:, :AROUND].any(axis=1)  # mentions that only their form tells
    model.same = _given(by_form[free].argmax(axis=1), label[what == OF_MENTION][free], count[what == OF_MENTION][free], AGREE)
    model.like = _given(parts[:, FORM:].argmax(axis=1), label[what == OF_PART], count[what == OF_PART], ALIKE)
    model.trained = True
    return model


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{LABELLED[k]}:{a}:{b}" for k, a, b in sorted(spans))


def found_in(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with base (the patterns' spans) and added (the field's): arrays of (kind, start, end)."""
    docs = set_aside(docs, "base", "added")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            base, added = [], []
            for text in batch.column(names.index(text_col)):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append(own)
                added.append(model.added(text, own))
            as_rows = lambda x: pa.array([[{"kind": LABELLED[k], "start": a, "end": b} for k, a, b in s] for s in x], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, as_rows(base), as_rows(added)], names=[*names, "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.mapInArrow(search, widened(docs, f"base {span}, added {span}"))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one."""
    cover = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise(F.signum((b["end"] - a["end"]).cast("double")).cast("int")))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(s["text"].alias("text"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(
        F.struct(F.concat(s["text"], F.col("text").substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")).alias("text"), x["end"].alias("at"))
    )
    done = F.aggregate(cover, zero, step)
    own = numbered(docs)
    place = own.columns[docs.columns.index("text")]
    x = found_in(own, model, place).withColumn("text", F.col(place))
    text = F.concat(done["text"], F.col("text").substr((done["at"] + 1).cast("int"), F.char_length("text")))
    x = x.withColumn(place, F.when(F.size(cover) > 0, text).otherwise(F.col("text")))
    return x.select(*own.columns).toDF(*docs.columns)
