"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find what is certain.  Tokens with a digit or an at sign are the
nodes of the field: neighbours without a word between them share one potential,
tokens repeated anywhere in the document another (numbers are alike if their
digits are).  What the patterns found is observed, loopy message passing carries
it to the document's other tokens, and tokens that then surely belong to a kind
become further spans.  Weights are learned from a bounded sample in which the
patterns' findings are the labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import fixed_sample, stretch, with_columns
from seriata.llm.workers import release

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9  # chance from which a token becomes a span
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000  # of a document that are learned from
SHAPES = 500
ROUNDS = 12  # of message passing
AT_ONCE = 256  # documents whose fields are solved together

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

# The patterns.  The look-behind only saves retries inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_ANY = re.compile("[0-9@]").search
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NOT_DIGIT = re.compile("[^0-9]")
_LETTERS = re.compile("a+")
_EDGE = ",;:!?\"'*#%&$|."
_SHAPE = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "a" for c in _LOCAL if c.isalpha()}})

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and kind; kinds may overlap."""
    if not _ANY(text):
        return []
    spans: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            spans.append((begin, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@dataclass(frozen=True)
class Field:
    """Weights: of shapes, digit counts and marks by label, of neighbours and of repeats by label pair."""

    shapes: dict[str, int]
    shape: np.ndarray
    digits: np.ndarray
    marks: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Graph:
    """Tokens of several documents; label 0 is none, otherwise 1 + the kind that the patterns found."""

    document: list[int]
    begin: list[int]
    end: list[int]
    shape: list[str]
    digits: list[int]
    marks: list[int]
    label: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(texts: list[str], found: list[list[Span]]) -> Graph:
    g = Graph([], [], [], [], [], [], [], [], [])
    for number, (text, spans) in enumerate(zip(texts, found)):
        if not _ANY(text):
            continue
        seen: dict[str, int] = {}
        before, nearest = -2, 0
        for m in _TOKEN.finditer(text):
            core = m[0].strip(_EDGE)
            if not core:
                continue
            node = len(g.begin)
            begin = m.start() + m[0].index(core)
            end = begin + len(core)
            while nearest < len(spans) and spans[nearest][2] <= begin and not any(s[2] > begin for s in spans[nearest : nearest + 4]):
                nearest += 1
            inside = [k for s, k, e in spans[nearest : nearest + 8] if s < end and begin < e]
            figures = _NOT_DIGIT.sub("", core)
            key = figures if len(figures) >= 7 else core.lower()
            g.document.append(number)
            g.begin.append(begin)
            g.end.append(end)
            g.shape.append(_LETTERS.sub("a", core.translate(_SHAPE))[:24])
            g.digits.append(min(len(figures), 20))
            g.marks.append(("@" in core) + 2 * ("." in core) + 4 * (core[0] == "+") + 8 * (len(figures) == len(core)))
            g.label.append(1 + inside[0] if inside else 0)
            if m.start() == before + 1:
                g.chain.append((node - 1, node))
            if key in seen:
                g.skip.append((seen[key], node))
            seen[key] = node
            before = m.end()
    return g


def _unary(field: Field, g: Graph) -> np.ndarray:
    other = len(field.shapes)
    shape = np.array([field.shapes.get(s, other) for s in g.shape], np.int64)
    return field.shape[shape] + field.digits[np.array(g.digits, np.int64)] + field.marks[np.array(g.marks, np.int64)]


def _edges(g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1], np.arange(len(both)) >= len(g.chain)


def learn(texts: list[str], rate: float = 0.1, steps: int = 200, ridge: float = 1e-3) -> Field:
    """Weights of greatest pseudo-likelihood, by Adam."""
    g = graph(texts, [base_spans(t) for t in texts])
    n, labels = len(g.label), 1 + len(KINDS)
    shapes = {s: i for i, (s, _) in enumerate(Counter(g.shape).most_common(SHAPES))}
    sizes = [(len(shapes) + 1, labels), (21, labels), (16, labels), (labels, labels), (labels, labels)]
    weights = [np.zeros(s) for s in sizes]
    if not n:
        return Field(shapes, *weights)
    y, other = np.array(g.label), len(shapes)
    index = [np.array([shapes.get(s, other) for s in g.shape]), np.array(g.digits), np.array(g.marks)]
    a, b, skips = _edges(g)
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    target = np.eye(labels)[y]
    for step in range(1, steps + 1):
        logits = sum(w[i] for w, i in zip(weights, index))
        for kind, pair in enumerate(weights[3:]):
            i, j = a[skips == kind], b[skips == kind]
            np.add.at(logits, j, pair[y[i]])
            np.add.at(logits, i, pair.T[y[j]])
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        error = (chance - target) / n
        slopes = [ridge / n * w for w in weights]
        for k in range(3):
            np.add.at(slopes[k], index[k], error)
        for kind in range(2):
            i, j = a[skips == kind], b[skips == kind]
            np.add.at(slopes[3 + kind], y[i], error[j])
            np.add.at(slopes[3 + kind].T, y[j], error[i])
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            weights[k] = weights[k] - rate * move
    return Field(shapes, *weights)


def marginals(field: Field, g: Graph) -> np.ndarray:
    """Chance of each label for each token, by loopy message passing with damping."""
    labels = 1 + len(KINDS)
    own = _unary(field, g)
    known = np.flatnonzero(g.label)
    own[known] = -50.0
    own[known, np.array(g.label)[known]] = 50.0
    a, b, skips = _edges(g)
    pair = np.where(skips[:, None, None], field.skip, field.chain)
    to, back = np.zeros((len(a), labels)), np.zeros((len(a), labels))
    for _ in range(ROUNDS if len(a) else 0):
        belief = own.copy()
        np.add.at(belief, b, to)
        np.add.at(belief, a, back)
        new = _log_sum((belief[a] - back)[:, :, None] + pair, 1)
        other = _log_sum((belief[b] - to)[:, None, :] + pair, 2)
        to, back = (to + new) / 2, (back + other) / 2
    np.add.at(own, b, to)
    np.add.at(own, a, back)
    chance = np.exp(own - own.max(1, keepdims=True))
    return chance / chance.sum(1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
    return out - out.max(1, keepdims=True)


def further_spans(field: Field, texts: list[str], found: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field adds to each document; none overlaps one of the patterns'."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, found)
    if not g.label:
        return out
    chance = marginals(field, g)
    best = chance.argmax(1)
    joined = {j for _, j in g.chain}
    for node in np.flatnonzero((best > 0) & (chance.max(1) >= SURE) & (np.array(g.label) == 0)).tolist():
        spans, kind = out[g.document[node]], int(best[node]) - 1
        if node in joined and spans and spans[-1][1] == kind and spans[-1][2] == g.end[node - 1]:
            spans[-1] = (spans[-1][0], kind, g.end[node])
        else:
            spans.append((g.begin[node], kind, g.end[node]))
    return out


def train(docs: DataFrame, n: int = SAMPLE_DOCS) -> Field:
    """Learn from a fixed choice of about ``n`` documents of ``docs(doc_id, text)`` with a digit or at sign.

    Of longer documents a stretch of ``SAMPLE_CHARS`` characters is taken, at a
    place fixed by their hash.
    """
    usable = docs.where(F.col("text").rlike("[0-9@]"))
    dealt = usable.select("doc_id", "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(16)).alias("deal"))
    chosen = fixed_sample(dealt, "deal", -(-n // 16)).select(stretch("text", SAMPLE_CHARS).alias("text"))
    chosen = chosen.orderBy(F.xxhash64("text"), "text")
    return learn(chosen.toArrow()["text"].to_pylist())


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Add ``spans`` to ``docs(text, ...)``: kind, start, end (exclusive, in code points), and whether a pattern found it.

    Spans are sorted by start, then by kind in the order of ``KINDS``.  A NULL
    or empty text has none.  Repeated rows stay; other columns pass through, a
    column ``spans`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(texts: list[str | None]) -> list[pa.Array]:
        release()
        rows = []
        for begin in range(0, len(texts), AT_ONCE):
            some = [t or "" for t in texts[begin : begin + AT_ONCE]]
            found = [base_spans(t) for t in some]
            for sure, more in zip(found, further_spans(sent.value, some, found)):
                both = sorted([(*s, True) for s in sure] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in both])
        return [pa.array(rows, pa.list_(span))]

    return with_columns(docs, run, f"spans {SPANS}")


def listed(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """Put ``<kind>`` in place of every span of ``docs(text, ...)``; spans that overlap become one, of the first's kind.

    A NULL text stays NULL.
    """
    found = find(docs, field)
    begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(done: Column, s: Column) -> Column:
        between = F.concat(F.substring(F.col("text"), done["at"], s["start"] + 1 - done["at"]), F.lit("<"), s["kind"], F.lit(">"))
        fresh = F.struct((s["end"] + 1).alias("at"), F.concat(done["text"], between).alias("text"))
        over = F.struct(F.greatest(done["at"], s["end"] + 1).alias("at"), done["text"].alias("text"))
        return F.when(s["start"] + 1 >= done["at"], fresh).otherwise(over)

    def finish(done: Column) -> Column:
        return F.concat(done["text"], F.substring(F.col("text"), done["at"], F.length("text")))

    return found.withColumn("text", F.aggregate("spans", begin, step, finish)).drop("spans")
