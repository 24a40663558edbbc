"""Toxicity by a string-kernel support vector machine.

The kernel of two tokens counts the subsequences of three letters they share,
each damped by the stretch it takes in either token, so that an insult with
gaps or inserted characters stays close to the insult.  A Nyström map over
landmark tokens makes the machine linear; because the kernel is itself a
product of explicit counts, landmarks and weights fold into one weight per
letter triple, and a token's margin is a weighted count of its triples.

Labels are given for documents.  The machine learns from their tokens: in a
toxic document the tokens that are rare elsewhere stand for it, later those
with a positive margin; the clean tokens that come closest are learned against
(multiple-instance learning with hard negatives).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import fixed_sample, stretch, with_columns
from seriata.llm.workers import kept
from seriata.session import settle

DECAY = 0.7
LANDMARKS = 256
SAMPLE_DOCS = 1500  # documents of each label that are learned from, about
SAMPLE_CHARS = 20_000  # of a document that are learned from
NEGATIVES = 3_000  # different tokens of clean documents, and as many of those that come closest
ROUNDS = 4
MENTIONS = 0.01  # share of the toxic texts in which a token must be found to stand for them
ODDS = 1.5  # how much likelier, in logarithms, it must be there than in clean ones
NEAR_BEST = 1.0  # and how close to the likeliest token of the text
WINDOW = 24  # letters that one kernel sees; longer tokens are seen in overlapping windows
THRESHOLD = 0.3
KEPT = 100_000  # tokens whose margins a worker remembers
FLOOR = -1.0  # the least margin that is told apart, and that of a text without tokens

_LETTERS = 64
_BEGIN = _LETTERS - 1  # stands before the first letter of a token
# Letters beyond a-z share the symbols 27 to 62.
_SYMBOL = np.array([c - 96 if 97 <= c <= 122 else 27 + c % 36 if chr(c).isalpha() else 0 for c in range(1 << 16)], np.int32)
_WORDS_AT_ONCE = 1 << 14
AT_ONCE = 256  # texts whose tokens are judged together


@dataclass(frozen=True)
class Machine:
    """Weight of each letter triple, bias, and the logistic function over the sum of a text's best two margins."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray


def tokens(text: str) -> list[str]:
    """Words in lower case; three or more single characters in a row also as one word."""
    words = text.lower().split()
    joined, run = [], []
    for word in words:
        if len(word) == 1:
            run.append(word)
        elif run:
            if len(run) > 2:
                joined.append("".join(run))
            run = []
    if len(run) > 2:
        joined.append("".join(run))
    return words + joined


def _windows(token: str) -> list[str]:
    """Pieces of at most ``WINDOW`` characters, each half over the next."""
    if len(token) <= WINDOW:
        return [token]
    return [token[i : i + WINDOW] for i in range(0, len(token) - WINDOW // 2, WINDOW // 2)]


def triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For strings of one length: code and damping of each place triple, ``(strings, triples)`` codes.

    All but letters is 0; a triple with a 0 has the code 0.
    """
    n = len(strings[0]) + 1
    raw = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").reshape(len(strings), n - 1)
    letters = np.full((len(strings), n), _BEGIN, np.int32)
    letters[:, 1:] = _SYMBOL[np.minimum(raw, len(_SYMBOL) - 1)]
    places = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    damping = DECAY ** (places[:, 2] - places[:, 0] + 1.0)
    a, b, c = (letters[:, places[:, i]] for i in range(3))
    code = ((a * _LETTERS + b) * _LETTERS + c) * ((a > 0) & (b > 0) & (c > 0))
    return code, damping


def weighted(
    strings: list[str], weights: np.ndarray, least: float = -np.inf, column: np.ndarray | None = None
) -> np.ndarray:
    """``(strings, rows of weights)``: weighted triple counts, each string's own kernel scaled to 1.

    Results that cannot exceed ``least`` are given as ``least``: equal triples
    only add to a string's own kernel, so without them it has a lower bound.
    ``column``: where the weight of a code stands, if not at the code itself.
    """
    out = np.zeros((len(strings), len(weights)))
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for n, at in by_length.items():
        if n < 2:
            continue
        step = max(1, (1 << 21) // (n * n * n))
        for begin in range(0, len(at), step):
            some = np.array(at[begin : begin + step])
            code, damping = triples([strings[i] for i in some])
            place = code if column is None else column[code]
            sums = np.stack([row[place] @ damping for row in weights], 1)
            own = (code > 0) @ damping**2
            bound = sums.max(1) / np.sqrt(np.where(own > 0, own, 1.0))
            near = bound > least
            if near.any():
                sums[near] /= np.sqrt(_own(code[near], damping))[:, None]
            sums[~near] = least
            out[some] = sums
    return out


def _own(code: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself: squared sums of equal triples."""
    order = np.argsort(code, 1, kind="stable")
    sorted_ = np.take_along_axis(code, order, 1)
    size = np.where(sorted_ > 0, damping[order], 0.0)
    new = np.ones(sorted_.shape, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, size.ravel())
    row = np.repeat(np.arange(len(code)), new.sum(1))
    own = np.bincount(row, total**2, len(code))
    return np.where(own > 0, own, 1.0)


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled triple counts of the landmarks and the codes they stand for; column 0 is for all others."""
    found = [triples([s]) for s in strings]
    codes = np.unique(np.concatenate([[0], *(code[0] for code, _ in found)]))
    out = np.zeros((len(strings), len(codes)))
    for row, (code, damping) in zip(out, found):
        np.add.at(row, np.searchsorted(codes, code[0]), damping)
    out[:, 0] = 0.0
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1.0), codes


def margins(words: list[str], machine: Machine) -> np.ndarray:
    """Margin of each token: that of its best window; ``FLOOR`` stands for anything below it."""
    parts = [_windows(w) for w in words]
    least = FLOOR - machine.bias if machine.bias < FLOOR else -np.inf
    flat = weighted([p for some in parts for p in some], machine.weights[None], least)[:, 0] + machine.bias
    return np.maximum.reduceat(flat, np.cumsum([0, *map(len, parts[:-1])])) if words else flat


def train_machine(texts: list[str], toxic: list[bool]) -> Machine:
    """Learn from whole texts; without both labels every text gets the same low score."""
    if not (any(toxic) and not all(toxic)):
        share = np.log((sum(toxic) + 0.5) / (len(toxic) - sum(toxic) + 9.5))
        return Machine(np.zeros(_LETTERS**3), 0.0, np.array([0.0, share]))
    once = list(dict(zip(texts, toxic)).items())  # copies of a text say nothing more
    bags = [[w for w in Counter(tokens(t)) if len(w) > 2] for t, _ in once]
    often = {label: Counter(w for bag, (_, is_) in zip(bags, once) if is_ == label for w in bag) for label in (True, False)}
    mentions = max(2, sum(is_ for _, is_ in once) * MENTIONS)
    odds = {w: np.log((n + 0.5) / (often[False][w] + 0.5)) for w, n in often[True].items() if n >= mentions}
    odds = {w: o for w, o in odds.items() if o >= ODDS}
    bad = [some for bag, (_, is_) in zip(bags, once) if is_ and (some := [w for w in bag if w in odds])]
    clean = sorted(often[False], key=lambda w: (-often[False][w], w))
    sure = clean[:: max(1, -(-len(clean) // NEGATIVES))]
    chosen = Counter(w for bag in bad for w in bag if odds[w] >= max(odds[x] for x in bag) - NEAR_BEST)
    machine, hard = Machine(np.zeros(_LETTERS**3), 0.0, np.zeros(2)), sure
    for _ in range(ROUNDS if chosen else 0):
        machine = _fit(chosen, [w for w in dict.fromkeys(hard + sure) if w not in chosen])
        found = dict(zip(odds, margins(list(odds), machine)))
        chosen = Counter(w for bag in bad for w in bag if found[w] > 0) or chosen
        order = np.argsort(-margins(clean, machine), kind="stable")
        hard = [clean[i] for i in order[:NEGATIVES] if clean[i] not in chosen]
    best = Judge(machine).best(texts)
    return Machine(machine.weights, machine.bias, _logistic(best, np.array(toxic, float)))


def _fit(positive: Counter, negative: list[str]) -> Machine:
    """Support vector machine on the Nyström map, folded back to letter triples."""
    common = [w for w, _ in positive.most_common(LANDMARKS // 2)]
    landmarks = [p for w in common + negative[: LANDMARKS - len(common)] for p in _windows(w)]
    base, codes = features(landmarks)
    column = np.zeros(_LETTERS**3, np.int32)
    column[codes] = np.arange(len(codes))
    kernel = base @ base.T
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # kernel rows to Nyström features
    words = list(positive) + negative
    parts = [_windows(w)[0] for w in words]
    x = np.hstack([weighted(parts, base, column=column) @ root, np.ones((len(words), 1))])
    y = np.where(np.arange(len(words)) < len(positive), 1.0, -1.0)
    share = np.array([*positive.values(), *[1.0] * len(negative)], float)
    share[: len(positive)] *= 0.5 / share[: len(positive)].sum()
    share[len(positive) :] *= 0.5 / share[len(positive) :].sum()
    solved = _squared_hinge(x, y, share)
    weights = np.zeros(_LETTERS**3)
    weights[codes] = base.T @ (root @ solved[:-1])
    return Machine(weights, float(solved[-1]), np.zeros(2))


def _squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 3e-5) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge * 1e-3
    for _ in range(50):
        active = y * (x @ w) < 1
        part = x[active] * share[active, None]
        new = np.linalg.solve(x[active].T @ part + np.diag(penalty), part.T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def _logistic(best: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Chance of the label from the sum of the two best margins, by Newton's method."""
    x = np.stack([best.sum(1), np.ones(len(best))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


class Judge:
    """Scores of whole texts, with the margins of known tokens remembered."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, float] = {}

    def best(self, texts: list[str]) -> np.ndarray:
        """The two largest margins of each text, over all its tokens."""
        split = [tokens(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = sorted(set().union(*split) - self.known.keys())
        for begin in range(0, len(new), _WORDS_AT_ONCE):
            some = new[begin : begin + _WORDS_AT_ONCE]
            self.known.update(zip(some, margins(some, self.machine).tolist()))
        known, out = self.known.__getitem__, np.full((len(texts), 2), FLOOR)
        for i, words in enumerate(split):
            found = np.array([FLOOR, FLOOR, *map(known, words)])
            out[i] = np.partition(found, len(found) - 2)[-2:][::-1]
        return np.maximum(out, FLOOR)

    def scores(self, texts: list[str]) -> np.ndarray:
        slope, start = self.machine.logistic
        at = self.best(texts).sum(1) * slope + start
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_DOCS) -> DataFrame:
    """``(text, toxic)`` of about ``each`` documents of either label, a fixed choice.

    ``docs(doc_id, text)``; of several labels of a document ``labels(doc_id,
    toxic)`` the highest counts.  Of longer documents a stretch of
    ``SAMPLE_CHARS`` characters is taken, at a place fixed by their hash.
    """
    marked = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    usable = docs.where("text IS NOT NULL").select("doc_id", "text")
    labelled = usable.select("doc_id").join(marked, "doc_id")
    chosen = settle(fixed_sample(labelled, "toxic", each, key=("doc_id",)))  # about twice ``each`` numbers
    rows = usable.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return rows.select(stretch("text", SAMPLE_CHARS).alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_DOCS) -> Machine:
    """Train on the bounded sample; its texts are all that reaches the driver."""
    rows = sample(docs, labels, each).orderBy(F.xxhash64("text"), "text").toArrow()
    return train_machine(rows["text"].to_pylist(), rows["toxic"].to_pylist())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Add ``score`` to every row of ``docs(text, ...)``.

    A NULL text counts as empty; an empty text has the score of a text whose
    every token is far from any insult.  Texts are scored whole.  Other columns
    pass through, a column ``score`` is replaced; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(texts: list[str | None]) -> list[pa.Array]:
        judge, whole = _judge(sent), [t or "" for t in texts]
        scores = [judge.scores(whole[i : i + AT_ONCE]) for i in range(0, len(whole), AT_ONCE)]
        return [pa.array(np.concatenate(scores))]

    return with_columns(docs, run, "score double")


def _judge(sent: Broadcast) -> Judge:
    """One judge per worker and machine, so that tokens are remembered from task to task."""
    return kept(("toxicity", id(sent.value)), lambda: Judge(sent.value))
