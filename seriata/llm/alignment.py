"""Alignment of two tokenizers: which tokens of one stand where which tokens of the other stand.

The tokens of a text are cut into groups wherever one of each ends at the same
byte; the two tokens that end there are linked.  Where a group is one token of A
and the token of B that has the same bytes, one number per token of A says all:
such links are counted in vectors as long as the vocabulary.  Only the links of
other groups are counted as pairs, by a shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriata.llm.common import bounded_batches, by_batch, joined, replaced, split_words
from seriata.llm.workers import kept, release
from seriata.session import settle

TEXT_CHARS = 1 << 15  # of words that are tokenized in one call
SCORED = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
COMMON = 1 << 16  # a pair is common if it makes up at least this part of all links by pairs

COLUMNS = ("a", "b", "a_ends", "b_ends")
_SPACE, _ALIKE = "▁", -1

GROUPS = "row long, doc_id long, a binary, b binary, a_ends binary, b_ends binary"


def _letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the rest come from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + i): byte for i, byte in enumerate(rest)}


Groups = tuple[bytes, bytes, bytes, bytes]  # the columns a, b, a_ends, b_ends of a text or a word
NOTHING: Groups = (b"", b"", b"", b"")


class Pair:
    """Tokenizers A (byte-level) and B (pieces), and the bytes of their tokens.

    A single space between two other characters begins a token of A and of B,
    so the groups of a text are those of its words, each with the space before it.
    The different words of a batch are tokenized once, and nothing is remembered from batch to batch.
    """

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = bytes(map(letters.__getitem__, token)) if all(t in letters for t in token) else token.encode()
        self.bytes_b = [_bytes_of(self.b, number) for number in range(self.b.vocab_size())]
        self.length_a, self.length_b = (np.array(list(map(len, tokens)), np.int64) for tokens in (self.bytes_a, self.bytes_b))
        self.begins_a, self.begins_b = (np.array([t[:1] == b" " for t in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        self.alike = alike(self.bytes_a, self.bytes_b)
        # A's pattern cuts at such a space; B must have no piece that goes over one.
        self.by_word = not any(b" " in token.lstrip(b" ") for token in self.bytes_b)

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        """The columns ``a, b, a_ends, b_ends`` of texts; empty where the tokens don't give a text back."""
        words, at = split_words(texts)
        whole, columns = self._learn(words.dictionary.to_pylist())
        odd = np.flatnonzero(np.diff(np.append(0, np.cumsum(~whole[words.indices.to_numpy()]))[at]))
        own = [self.of_text(texts[int(i)].as_py() or "") for i in odd]
        return [
            replaced(joined(column.take(words.indices), at), odd, [groups[i] for groups in own])
            for i, column in enumerate(columns)
        ]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        """The columns of each word, and which words can be put together.

        Not so those that white space touches and those that don't come back, which have no tokens here.
        """
        whole = np.array([self.by_word and w != "" and not (w[0].isspace() or w[-1].isspace() or _SPACE in w) for w in words], bool)
        nothing = np.zeros(0, np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = [(nothing, nothing)]
        n_a, n_b = (np.zeros(len(words), np.int64) for _ in range(2))
        for places in _portions(np.flatnonzero(whole), words):
            todo = [places]
            while todo:
                places = todo.pop()
                tokens = self._tokens(" ".join([words[i] for i in places]))
                if tokens[0] is not None:
                    found.append(tokens)
                    for n, ids, begins in zip((n_a, n_b), tokens, (self.begins_a, self.begins_b)):
                        starts = np.flatnonzero(begins[ids])
                        assert len(starts) == len(places)
                        n[places] = np.diff(np.append(starts, len(ids)))
                elif len(places) > 1:
                    todo += [places[len(places) // 2 :], places[: len(places) // 2]]
                else:
                    whole[places] = False
        a, b = map(np.concatenate, zip(*found))
        ends = ends_of(a, b, self.length_a, self.length_b)
        columns = [_binary(x.astype("<u4"), n) for x, n in ((a, n_a), (b, n_b))] + [_binary(e, n) for e, n in zip(ends, (n_a, n_b))]
        return whole, columns

    def of_text(self, text: str) -> Groups:
        a, b = self._tokens(text)
        if a is None:
            return NOTHING
        ends = ends_of(a, b, self.length_a, self.length_b)
        return a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), ends[0].tobytes(), ends[1].tobytes()

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
        """Numbers of A for a space and the text, and of B, if both give back every byte."""
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        raw = (" " + text).encode()
        if not text or any(b"".join(map(known.__getitem__, ids)) != raw for known, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None, None
        return np.array(a, np.int32), np.array(b, np.int32)


def _bytes_of(model: sentencepiece.SentencePieceProcessor, number: int) -> bytes:
    piece = model.id_to_piece(number)
    if model.is_byte(number):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_SPACE, " ").encode()


def alike(bytes_a: list[bytes], bytes_b: list[bytes]) -> np.ndarray:
    """For each token of A the one of B with the same bytes, the largest number of several; -1 if there is none."""
    numbers = {token: number for number, token in enumerate(bytes_b)}
    return np.array([numbers.get(token, _ALIKE) for token in bytes_a], np.int32)


def ends_of(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of two sequences over the same bytes end where one of the other ends."""
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    at = np.searchsorted(ends_b, ends_a)  # the last byte ends one of each, so there is always a place
    meet = ends_b[at] == ends_a
    other = np.zeros(len(b), bool)
    other[at[meet]] = True
    return meet, other


def written(a: bytes, b: bytes, a_ends: bytes, b_ends: bytes) -> str:
    """Groups as text, such as ``a1,a2|b1;a3|b2,b3``."""
    if not a:
        return ""
    key = []
    for side, ends in enumerate((a_ends, b_ends)):
        last = np.frombuffer(ends, bool)
        key.append(2 * (np.cumsum(last) - last) + side)  # the group, and in it A before B
    key = np.concatenate(key)
    order = np.argsort(key, kind="stable")
    key, numbers = key[order], np.concatenate([np.frombuffer(x, "<u4") for x in (a, b)])[order].tolist()
    mark = np.where(key[1:] == key[:-1], 0, np.where(key[1:] & 1, 1, 2)).tolist()
    marks = (",", "|", ";")
    return "".join([f"{n}{marks[m]}" for n, m in zip(numbers, mark)]) + str(numbers[-1])


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The tokens of every row of ``docs(doc_id, text)`` by A and by B, and their groups.

    Gives ``row, doc_id, a, b, a_ends, b_ends``: token numbers as little-endian
    unsigned 32-bit integers, and a byte for each token that is 1 if it is the
    last of its group.  A stands for a space and the text, as B puts a space in
    front itself.  A text that is NULL or empty, or of which the tokens of A or B
    do not give back every byte (say, because it holds the letter that stands
    for a space in B), has no tokens and no groups.  Texts are taken whole;
    repeated rows, and rows without ``doc_id``, are rows of their own; other
    columns are ignored.  ``row`` tells rows apart once they are written.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = kept(("alignment", a, b), lambda: Pair(a, b))
        return pa.record_batch([batch.column(0), batch.column(1), *pair.columns(batch.column(2))], ["row", "doc_id", *COLUMNS])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_batch(rows, run, GROUPS)


def _portions(places: np.ndarray, words: list[str]) -> Iterator[np.ndarray]:
    """The places in parts of words of ``TEXT_CHARS`` letters, about."""
    sizes = np.cumsum([len(words[i]) + 1 for i in places]) // TEXT_CHARS
    yield from (part for part in np.split(places, np.flatnonzero(np.diff(sizes)) + 1) if len(part))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of the bytes of the values, ``sizes`` of them each."""
    ends = values.itemsize * np.append(0, np.cumsum(sizes))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


class _Links:
    """The links of some rows of groups: the last tokens of A and of B of each group."""

    def __init__(self, batch: pa.RecordBatch, known: np.ndarray):
        parts = [batch.column(batch.schema.get_field_index(c)) for c in COLUMNS]
        a, b, a_ends, b_ends = (np.frombuffer(b"".join(p.to_pylist()), kind) for p, kind in zip(parts, ("<u4", "<u4", bool, bool)))
        self.a, self.b = a[a_ends].astype(np.int64), b[b_ends].astype(np.int64)
        self.n_a, self.n_b = (np.array(pc.binary_length(p), np.int64) for p in parts[2:])
        self.rows = np.repeat(np.arange(batch.num_rows), self.n_a)[a_ends]
        # a group of one token of A is one of B too if both have the same bytes
        alone = a_ends.copy()
        alone[1:] &= a_ends[:-1]
        starts = np.cumsum(self.n_a) - self.n_a
        starts = starts[self.n_a > 0]
        alone[starts] = a_ends[starts]
        self.plain = alone[a_ends] & (known[self.a] == self.b)

    def pairs(self) -> np.ndarray:
        """A number for each link that is not plain: 2^32 times A's token, and B's."""
        return self.a[~self.plain] << 32 | self.b[~self.plain]


@dataclass(frozen=True)
class Counts:
    """How often tokens are linked.

    ``plain[a]`` counts A's token with ``alike[a]``, the token of the same
    bytes; ``pairs(pair, n)`` holds all other pairs.  ``best[b]`` is the highest
    count of B's token in either.  ``common`` are the pairs, sorted, that each
    make up at least 1/65,536 of the links in ``pairs``, so 65,536 at most, with their counts.
    """

    alike: np.ndarray
    plain: np.ndarray
    pairs: DataFrame
    best: np.ndarray
    common: np.ndarray
    common_n: np.ndarray


def count(groups: DataFrame, known: np.ndarray, n_b: int) -> Counts:
    """Count the links of all ``groups``; ``known`` is ``alike``, ``n_b`` the number of B's tokens.

    Each task gives a vector of its plain links, and each of its batches a row for each other pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        plain = np.zeros(len(known), np.int64)
        for batch in batches:
            links = _Links(batch, known)
            plain += np.bincount(links.a[links.plain], minlength=len(known))
            pair, n = np.unique(links.pairs(), return_counts=True)
            yield pa.record_batch([np.ones(len(pair), bool), pair, n], ["is_pair", "key", "n"])
        at = np.flatnonzero(plain)
        yield pa.record_batch([np.zeros(len(at), bool), at, plain[at]], ["is_pair", "key", "n"])

    bounded_batches(groups.sparkSession)
    partial = settle(groups.select(*COLUMNS).mapInArrow(run, "is_pair boolean, key long, n long"))
    summed = partial.where("NOT is_pair").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    plain = np.zeros(len(known), np.int64)
    plain[summed["key"].to_numpy()] = summed["n"].to_numpy()

    pairs = settle(partial.where("is_pair").groupBy(F.col("key").alias("pair")).agg(F.sum("n").alias("n")))
    highest = pairs.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, known[known >= 0], plain[known >= 0])
    np.maximum.at(best, highest["b"].to_numpy(), highest["n"].to_numpy())

    links = pairs.agg(F.sum("n")).first()[0] or 0
    common = pairs.where(F.col("n") * COMMON >= F.lit(max(links, 1))).orderBy("pair").toArrow()
    return Counts(known, plain, pairs, best, common["pair"].to_numpy(), common["n"].to_numpy())


def score(groups: DataFrame, counts: Counts) -> DataFrame:
    """Every row of ``groups`` with what its links count.

    Gives ``row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum``:
    ``n_best`` links have the highest count of their token of B, ties included;
    ``count_sum`` adds the counts of all links.  ``groups`` must be the rows that
    were counted, settled.  Only links by pairs that are not common are
    joined; none of those makes up 1/65,536 of the rows, so no key is hot.
    """
    spark = groups.sparkSession
    sent = spark.sparkContext.broadcast((counts.alike, counts.plain, counts.best, counts.common, counts.common_n))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        known, plain, best, common, common_n = sent.value
        links, rows = _Links(batch, known), batch.num_rows
        n = np.zeros(len(links.a), np.int64)
        n[links.plain] = plain[links.a[links.plain]]
        pair = links.pairs()
        place = np.searchsorted(common, pair)
        found = np.append(common, -1)[place] == pair
        n[~links.plain] = np.where(found, np.append(common_n, 0)[place], 0)
        is_best = np.bincount(links.rows, (n > 0) & (n == best[links.b]), minlength=rows).astype(np.int64)
        total = np.zeros(rows, np.int64)
        np.add.at(total, links.rows, n)
        of = links.rows[~links.plain][~found]
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(pair[~found]))
        n_groups = np.bincount(links.rows, minlength=rows)
        columns = [batch.column(0), batch.column(1), links.n_a, links.n_b, n_groups, n_groups, is_best, total, rare]
        return pa.record_batch(columns, [*SCORED, "rare"])

    scored = settle(by_batch(groups, run, ", ".join(f"{c} long" for c in SCORED) + ", rare array<long>"))
    of_b = spark.createDataFrame(pa.table({"b": np.arange(len(counts.best)), "best": counts.best}))
    counted = counts.pairs.join(F.broadcast(of_b), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b"))
    counted = counted.select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    rare = scored.select("row", F.explode("rare").alias("pair")).join(counted, "pair")
    more = rare.groupBy("row").agg(F.sum("is_best").alias("__best"), F.sum("n").alias("__sum"))
    summed = scored.drop("rare").join(more, "row", "left")
    zero = F.lit(0).cast("long")
    sums = {"n_best": F.col("n_best") + F.coalesce("__best", zero), "count_sum": F.col("count_sum") + F.coalesce("__sum", zero)}
    return summed.withColumns(sums).select(*SCORED)


def texts(groups: DataFrame) -> DataFrame:
    """``(row, groups)``: the groups of each row as text, as ``written`` has them; empty without tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        found = [written(*groups) for groups in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["row", "groups"])

    return by_batch(groups, run, "row long, groups string")


def vocabularies(a: str, b: str) -> tuple[np.ndarray, int]:
    """``alike`` for the two files, and the number of B's tokens."""
    pair = Pair(a, b)
    return pair.alike, len(pair.bytes_b)
