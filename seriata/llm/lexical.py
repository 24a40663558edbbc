"""Ranked lexical search: every document against every item, by products of dense tiles.

Items are searched in blocks whose terms fit a broadcast.  A task turns some of
its documents at a time into a tile of impacts, one column for each term that a
tile of items holds, and multiplies it with the items' weights.  Impacts and
weights are whole numbers; a tile has as many columns as keep every sum below
2^53, so that products of doubles are exact, and tiles are added up as integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import bounded_batches, by_batch
from seriata.session import settle

BLOCK_TERMS = 1 << 18  # different terms of items, item by item, that are searched at once
DOCS, ITEMS, COLUMNS = 256, 64, 4096  # size of tiles
PART = 1 << 20  # bytes of a text that are cut into terms at once

# The weights of length and the scales of the score.
_PER_TERM, _PER_DOC, _TF, _LENGTH, _FLAT, _SLOPE = 1000, 1_000_000_000, 1000, 8, 100, 75
_MOST = _PER_DOC // _TF  # no impact is larger
_EXACT, _LIMB = 1 << 53, 32

# Bytes that belong to a term stand for themselves, A-Z for a-z, all others for a space.
_KEEP = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a part of the text at a time."""
    raw = (text or "").encode().translate(_KEEP)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + PART)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


@dataclass(frozen=True)
class Block:
    """Items as rows of ``(item, term, times)``, items and terms numbered from 0."""

    items: np.ndarray  # the number of each item in the table of items
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Corpus:
    docs: int  # with at least one term
    length: int  # terms of all documents
    df: np.ndarray  # documents that hold each term of the block


def counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of terms of a text, and which of the vocabulary it holds how often."""
    n, found = 0, Counter()
    for part in terms(text):
        n += len(part)
        found.update(i for i in map(vocabulary.get, part) if i is not None)
    return n, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def measure(docs: DataFrame, block: Block) -> Corpus:
    """Counts over all ``docs(text)``; each task gives one number for each term of the block at most."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        df, size, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, held, _ = counted(text, vocabulary)
                df[held] += 1
                size += n > 0
                length += n
        at = np.flatnonzero(df)
        yield pa.record_batch([np.append(at, [-2, -1]), np.append(df[at], [size, length])], ["term", "n"])

    bounded_batches(docs.sparkSession)
    total = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(total["term"].to_pylist(), total["n"].to_pylist()))
    df = np.array([found.get(i, 0) for i in range(len(block.vocabulary))], np.int64)
    return Corpus(found.get(-2, 0), found.get(-1, 0), df)


def weights(corpus: Corpus) -> np.ndarray:
    """How much each term counts."""
    most = 2 * corpus.docs + 2
    return np.array([math.floor(_PER_TERM * math.log(most / (2 * df + 1))) for df in corpus.df.tolist()], np.int64)


def impacts(n: int, times: np.ndarray, corpus: Corpus) -> np.ndarray:
    """How much terms that a document of ``n`` terms holds ``times`` count in it."""
    m = _FLAT - _SLOPE + _SLOPE * n * corpus.docs // corpus.length
    return _PER_DOC * times // (_TF * times + _LENGTH * m)


@dataclass(frozen=True)
class Tile:
    """The weights of some items for some terms, ``2**shift`` times what they stand for."""

    first: int
    items: int
    terms: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray
    shift: int

    def add(self, scores: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Add what documents score for the tile's terms to ``scores``, a row for each document."""
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        held = self.terms[place] == term
        if held.any():
            left = np.zeros((len(scores), len(self.terms)))
            left[doc[held], place[held]] = impact[held]
            right = np.zeros((len(self.terms), self.items))
            right[self.row, self.column] = self.weight
            scores[:, self.first : self.first + self.items] += (left @ right).astype(np.int64) << self.shift


def tiles(block: Block, weight: np.ndarray) -> list[Tile]:
    """Tiles of at most ``ITEMS`` items and ``COLUMNS`` terms, no product of which reaches 2^53."""
    made = []
    counts = block.times * weight[block.term]
    for first in range(0, len(block.items), ITEMS):
        inside = np.flatnonzero((block.item >= first) & (block.item < first + ITEMS) & (counts > 0))
        if not len(inside):
            continue
        known, row = np.unique(block.term[inside], return_inverse=True)
        for shift in (0, _LIMB):
            limb = counts[inside] >> shift & ((1 << _LIMB) - 1)
            if not limb.any():
                continue
            most = np.zeros(len(known), np.int64)
            np.maximum.at(most, row, limb)
            for begin, end in _spans(most.tolist()):
                here = np.flatnonzero((row >= begin) & (row < end))
                column = block.item[inside[here]] - first
                items = min(ITEMS, len(block.items) - first)
                made.append(Tile(first, items, known[begin:end], row[here] - begin, column, limb[here].astype(float), shift))
    return made


def _spans(most: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, value in enumerate(most):
        if i - begin == COLUMNS or (total + value) * _MOST >= _EXACT:
            yield begin, i
            begin, total = i, 0
        total += value
    yield begin, len(most)


class Best:
    """The ``k`` best documents of each item so far: highest score, then smallest number, those without one last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # what a document has to reach
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.nameless = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, nameless: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        self.item = np.concatenate([self.item, item])
        self.score = np.concatenate([self.score, scores[row, item]])
        self.doc = np.concatenate([self.doc, doc[row]])
        self.nameless = np.concatenate([self.nameless, nameless[row]])
        order = np.lexsort([self.doc, self.nameless, -self.score, self.item])
        _, begin, of = np.unique(self.item[order], return_index=True, return_inverse=True)
        rank = np.arange(len(order)) - begin[of]
        last = order[rank == self.k - 1]
        self.least[self.item[last]] = self.score[last]
        order = order[rank < self.k]
        self.item, self.score, self.doc, self.nameless = (x[order] for x in (self.item, self.score, self.doc, self.nameless))


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item, equal scores by ``doc_id``.

    ``docs(doc_id, text)`` and ``items(item_id, text)`` give ``item_id, rank,
    doc_id, score``.  Every row of ``docs`` is a document, a repeated one too;
    those without ``doc_id`` come last among equals.  Repeated rows of ``items``
    count once; rows of one ``item_id`` with other texts, or without
    ``item_id``, are items of their own.  NULL and empty texts have no terms;
    such items, and items without any match, give no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stated = settle(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    stated = settle(stated.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    held = settle(_terms_of(stated))
    n = _blocks(held)
    number = F.pmod(F.xxhash64("item"), F.lit(n))
    found = [_search(rows, _block(held.where(number == i)), k) for i in range(n)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(stated.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _terms_of(items: DataFrame) -> DataFrame:
    """``(item, term, times)``"""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        item, term, times = [], [], []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Counter()
            for part in terms(text):
                found.update(part)
            item += [number] * len(found)
            term += found.keys()
            times += found.values()
        columns = [pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())]
        return pa.record_batch(columns, ["item", "term", "times"])

    return by_batch(items.select("item", "text"), run, "item long, term binary, times long")


def _blocks(held: DataFrame) -> int:
    """In how many blocks to search: none has over twice ``BLOCK_TERMS`` rows, but if an item alone has more."""
    n = max(1, -(-held.count() // BLOCK_TERMS))
    while n > 1:
        sizes = held.groupBy(F.pmod(F.xxhash64("item"), F.lit(n))).agg(F.count(F.lit(1)).alias("rows"), F.min("item").alias("a"), F.max("item").alias("b"))
        if sizes.where((F.col("rows") > 2 * BLOCK_TERMS) & (F.col("a") < F.col("b"))).isEmpty():
            break
        n *= 2
    return n


def _block(held: DataFrame) -> Block:
    rows = held.orderBy("item", "term").toArrow()
    items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
    vocabulary: dict[bytes, int] = {}
    term = [vocabulary.setdefault(t, len(vocabulary)) for t in rows["term"].to_pylist()]
    return Block(items, vocabulary, item, np.array(term, np.int64), rows["times"].to_numpy())


def _search(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the best ``k`` of every task."""
    corpus = measure(docs, block)
    sent = docs.sparkSession.sparkContext.broadcast((block, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, corpus = sent.value
        sized, best = tiles(block, weights(corpus)), Best(len(block.items), k)
        for batch in batches:
            for begin in range(0, batch.num_rows, DOCS):
                some = batch.slice(begin, DOCS)
                ids, texts = some.column(0), some.column(1).to_pylist()
                held = [counted(text, block.vocabulary) for text in texts]
                doc = np.repeat(np.arange(len(held)), [len(term) for _, term, _ in held])
                term = np.concatenate([term for _, term, _ in held])
                impact = np.concatenate([impacts(n, times, corpus) if n else times for n, _, times in held])
                scores = np.zeros((len(held), len(block.items)), np.int64)
                for tile in sized:
                    tile.add(scores, doc, term, impact)
                best.add(scores, ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()))
        found = pa.array(best.doc, pa.int64(), mask=best.nameless)
        yield pa.record_batch([block.items[best.item], found, best.score], ["item", "doc_id", "score"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, "item long, doc_id long, score long")
