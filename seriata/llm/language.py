"""Language by prediction by partial matching.

Every language has a tree of byte contexts of up to ``ORDER`` bytes, learned
from a sample and then frozen.  A byte is coded in the longest context that has
seen it; each longer context that exists but has not pays its escape
probability (method C: as many escapes as different bytes followed).  The text
belongs to the language with the shortest code.  A word is coded from the space
before it to the space behind it and contexts do not reach into the word
before, so that the exact code length of a text is a sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import by_batch, fixed_sample, stretch, with_columns
from seriata.llm.workers import kept

ORDER = 4
SAMPLE_DOCS = 500  # documents a language is learned from, about
SAMPLE_CHARS = 20_000  # of a document that are learned from
KEPT = 100_000  # words whose code lengths a worker remembers
UNKNOWN = "und"
AT_ONCE = 256  # texts whose words are coded together
_WORDS_AT_ONCE = 1 << 15

_has_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Model:
    """Frozen trees of all languages over one sorted list of byte strings.

    ``bits[g, l]``: code length of the last byte of string ``g`` after the bytes
    before it, escapes from that context on included.  ``escapes[c, l]``: what
    leaving context ``c`` costs.  Strings are numbers: bytes, then their count.
    """

    languages: tuple[str, ...]
    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def grams_of(words: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order, from 0: byte strings that end at each byte of the words, and where they exist.

    The space before a word is context only; the space behind it is coded.
    """
    joined = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words]) + 2
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.arange(len(joined)) - begins  # bytes before this one in its word, space included
    value = np.zeros_like(joined)
    for k in range(order + 1):
        shifted = np.concatenate([np.zeros(k, np.int64), joined[: len(joined) - k]])
        value = value | (shifted << (8 * k))
        yield value | (k + 1) << 48, (depth >= max(k, 1))


def learn(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """Trees from ``language -> (byte strings, how often)``."""
    languages = tuple(sorted(counts))
    n = len(languages)
    grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in counts.values())]))
    count = np.zeros((len(grams), n))
    for l, language in enumerate(languages):
        strings, times = counts[language]
        count[np.searchsorted(grams, strings), l] = times
    size = grams >> 48
    context = ((grams & ((1 << 48) - 1)) >> 8) | (size - 1) << 48
    contexts, where = np.unique(context, return_inverse=True)
    total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
    np.add.at(total, where, count)
    np.add.at(kinds, where, count > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        escapes = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
        seen = -np.log2(count / (total + kinds)[where])
    bits = np.zeros_like(count)
    for k in range(1, order + 2):
        at = np.flatnonzero(size == k)
        if k == 1:
            shorter = np.full((len(at), n), 8.0)
        else:
            tail = (grams[at] & ((1 << 8 * (k - 1)) - 1)) | (k - 1) << 48
            shorter = bits[np.searchsorted(grams, tail)]
        bits[at] = np.where(count[at] > 0, seen[at], escapes[where[at]] + shorter)
    return Model(languages, grams, bits, contexts, escapes)


def code_lengths(model: Model, words: list[bytes], order: int = ORDER) -> np.ndarray:
    """Bits of each word in each language."""
    strings = list(grams_of(words, order))
    coded = strings[0][1]  # not the spaces before words
    bits = np.zeros((len(coded), len(model.languages)))
    open_ = coded.copy()
    for value, exists in reversed(strings):
        at = np.flatnonzero(open_ & exists)
        place, found = _find(model.grams, value[at])
        bits[at[found]] += model.bits[place[found]]
        open_[at[found]] = False
        rest = at[~found]
        context = ((value[rest] & ((1 << 48) - 1)) >> 8) | ((value[rest] >> 48) - 1) << 48
        place, found = _find(model.contexts, context)
        bits[rest[found]] += model.escapes[place[found]]
    bits[open_] += 8.0
    ends = np.cumsum([len(w) + 2 for w in words])
    return np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]), axis=0)


def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return place, sorted_[place] == values


class Coder:
    """Code lengths of whole texts, with the words' lengths remembered."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.bits = np.zeros((0, len(model.languages)))

    def lengths(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.place) > KEPT:
            self.place, self.bits = {}, self.bits[:0]
        new = sorted(set().union(*split) - self.place.keys())
        for begin in range(0, len(new), _WORDS_AT_ONCE):
            some = new[begin : begin + _WORDS_AT_ONCE]
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some))))
            self.bits = np.concatenate([self.bits, code_lengths(self.model, some)])
        place = self.place.__getitem__
        return np.array([self.bits[list(map(place, words))].sum(0) for words in split])


def sample_counts(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``(lang, gram, n)`` over a fixed choice of ``docs(doc_id, text, lang)`` per language."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    chosen = fixed_sample(usable, "lang", docs_per_language).select("lang", stretch("text", SAMPLE_CHARS).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_language: dict[str, list[bytes]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_language.setdefault(language, []).extend(words_of(text))
        languages, grams, times = [], [], []
        for language, words in by_language.items():
            if words:
                strings = np.concatenate([value[exists] for value, exists in grams_of(words)])
                gram, n = np.unique(strings, return_counts=True)
                languages += [language] * len(gram)
                grams.append(gram)
                times.append(n)
        none = np.zeros(0, np.int64)
        columns = [pa.array(languages, pa.string()), np.concatenate([none, *grams]), np.concatenate([none, *times])]
        return pa.record_batch(columns, ["lang", "gram", "n"])

    counted = by_batch(chosen, run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> Model:
    """Trees from about ``docs_per_language`` documents of each language.

    Of longer documents a stretch of ``SAMPLE_CHARS`` characters is taken, at a
    place fixed by their hash, so what reaches the driver is bounded by the
    number of languages.
    """
    rows = sample_counts(docs, docs_per_language).toArrow()
    language = rows["lang"].combine_chunks().dictionary_encode()
    code, gram, n = language.indices.to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy()
    return learn({name: (gram[code == i], n[code == i]) for i, name in enumerate(language.dictionary.to_pylist())})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``bits`` to every row of ``docs(text, ...)``.

    ``score`` is the chance of the predicted language, all languages being as
    likely beforehand; ``bits`` is the text's code length in it per byte, NULL
    where there is none.  A text that is NULL or has no letter, and any text if no
    language was learned, is ``und`` with the score 0.  Ties go to the language
    that sorts first.  Other columns pass through, columns of the three names are
    replaced; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        languages = sent.value.languages
        names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        judged = [i for i, t in enumerate(texts) if t and _has_letter(t)] if languages else []
        for begin in range(0, len(judged), AT_ONCE):
            some = judged[begin : begin + AT_ONCE]
            for i, bits in zip(some, _coder(sent).lengths([texts[i] for i in some])):
                best = int(np.argmin(bits))
                names[i] = languages[best]
                rates[i] = float(bits[best]) / sum(len(w) + 1 for w in words_of(texts[i]))
                scores[i] = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]

    return with_columns(docs, run, "lang_pred string, score double, bits double")


def _coder(sent: Broadcast) -> Coder:
    """One coder per worker and model, so that words are remembered from task to task."""
    return kept(("language", id(sent.value)), lambda: Coder(sent.value))
