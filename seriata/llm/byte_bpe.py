"""Byte-level pair merges: encoding by backtracking from the longest match, and decoding.

A sequence of tokens is what the merges give if and only if that holds for each
two tokens in a row (van Antwerpen and Neubeck, "So many tokens, so little
time", 2024).  So every place before the end of a chunk has one encoding of what
lies before it at most; a search that goes on with the longest match, and back
where nothing fits, visits a place a bounded number of times.

That holds if merges of lower rank make every token, as in any trained table.
In a table with other tokens, chunks that hold one are merged step by step.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from seriata.llm.common import joined, replaced, split_words, with_columns
from seriata.llm.workers import kept

PATTERN = public_tokenizers.PATTERN
KEPT = 200_000  # words, chunks, and pairs of tokens, that a worker remembers
KEPT_CHARS = 64  # longer chunks are not remembered
SHORT = 32  # bytes of a chunk whose tokens are looked up one by one
PREFIX = 4  # bytes that bound how long a token looked up can be
BLOCK = 1 << 14  # bytes of a chunk whose matches are held together
_NEVER = 1 << 40


@lru_cache(maxsize=1)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks; a line of the file has the bytes in base64 and the rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(pair[0]): int(pair[1]) for pair in pairs if pair}


def merged(raw: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[bytes]:
    """Merge neighbours by lowest rank, the first of equals, while one is under ``below``; for short ``raw``."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        least = min(rank)
        if least >= below:
            break
        at = rank.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Matches:
    """The tokens that begin at each place of a chunk, short ones first."""

    def __init__(self, automaton: ahocorasick.Automaton, text: str, longest: int):
        self.automaton, self.text, self.longest = automaton, text, longest
        self.blocks: dict[int, list[list[int]]] = {}

    def __getitem__(self, place: int) -> list[int]:
        number = place // BLOCK
        block = self.blocks.get(number)
        if block is None:
            if len(self.blocks) > 3:
                self.blocks.clear()
            begin = number * BLOCK
            size = min(BLOCK, len(self.text) - begin)
            block = self.blocks[number] = beginning(self.automaton, self.text[begin : begin + size + self.longest - 1], size)
        return block[place % BLOCK]


def beginning(automaton: ahocorasick.Automaton, text: str, size: int) -> list[list[int]]:
    """The tokens that begin at each of the first ``size`` places."""
    found: list[list[int]] = [[] for _ in range(len(text))]
    for end, (token, before) in automaton.iter(text):
        found[end - before].append(token)
    return found[:size]


def _closed(word: str) -> bool:
    """Whether no white space touches the single spaces around the word."""
    return word != "" and not word[0].isspace() and not word[-1].isspace()


class Encoder:
    """``encode_ordinary`` of the tiktoken library for a table of ranks, chunk by chunk."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks = read_ranks(path)
        self.chunks = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.length = {rank: len(token) for token, rank in self.ranks.items()}
        self.start = max(self.tokens) + 1  # stands before the first token of a chunk
        self.longest = max(map(len, self.ranks))
        # the longest token that begins with these bytes; others are shorter than they
        self.reach = {token[:PREFIX]: len(token) for token in sorted(self.ranks, key=len) if len(token) >= PREFIX}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.halves = {rank: self._halves(token) for token, rank in self.ranks.items()}
        self.odd = frozenset(rank for rank, halves in self.halves.items() if halves is None)
        self.fitting: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # With the usual pattern a single space between two other characters always begins a chunk,
        # so a word and the space before it can be remembered whole.
        self.by_word = pattern == public_tokenizers.PATTERN
        self.words: dict[str, bytes] = {}

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Numbers of the tokens of each text as little-endian unsigned 32-bit integers; the words of all are met once."""
        words, at = split_words(texts)
        different, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        closed = np.array([self.by_word and _closed(word) for word in different], bool)
        # the first word of a text has no space before it
        first, own = np.unique(codes[at[:-1]], return_inverse=True)
        numbers = [self._word(word) if whole else b"" for word, whole in zip(different, closed)]
        numbers += [self.encode(different[i]) if closed[i] else b"" for i in first]
        odd = np.flatnonzero(np.diff(np.append(0, np.cumsum(~closed[codes]))[at]))
        codes = codes.copy()
        codes[at[:-1]] = len(different) + own
        found = joined(pa.array(numbers, pa.binary()).take(pa.array(codes)), at)
        return replaced(found, odd, [self.encode(texts[int(i)].as_py() or "") for i in odd])

    def _word(self, word: str) -> bytes:
        numbers = self.words.get(word)
        if numbers is None:
            numbers = self.encode(" " + word)
            if len(word) <= KEPT_CHARS:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = numbers
        return numbers

    def encode(self, text: str) -> bytes:
        """Numbers of the tokens of one text."""
        return b"".join(map(self._chunk_numbers, self.chunks(text)))

    def _chunk_numbers(self, chunk: str) -> bytes:
        numbers = self.known.get(chunk)
        if numbers is None:
            taken = self.encode_chunk(chunk.encode())
            numbers = struct.pack(f"<{len(taken)}I", *taken)
            if len(chunk) <= KEPT_CHARS:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[chunk] = numbers
        return numbers

    def encode_chunk(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        text, size = raw.decode("latin-1"), len(raw)
        if self.odd and any(token in self.odd for _, (token, _) in self.automaton.iter(text)):
            return [self.ranks[part] for part in merged(raw, self.ranks)]
        if size <= SHORT and not self.odd:
            return self._encode_short(raw)
        matches = beginning(self.automaton, text, size) if size <= BLOCK else Matches(self.automaton, text, self.longest)
        length, fits, fitting = self.length, self.fits, self.fitting
        dead = bytearray(size + 1)  # nothing fits behind these places
        taken: list[int] = []
        untried: list[int] = []  # how many shorter matches each token taken leaves
        place, last = 0, self.start
        choice = matches[0]
        rest = len(choice)
        while place < size:
            while rest:
                rest -= 1
                token = choice[rest]
                end = place + length[token]
                if not dead[end]:
                    fit = fitting.get(last << 32 | token)
                    if fits(last, token) if fit is None else fit:
                        taken.append(token)
                        untried.append(rest)
                        place, last = end, token
                        if end < size:
                            choice = matches[end]
                            rest = len(choice)
                        break
            else:
                dead[place] = 1
                place -= length[taken.pop()]
                rest = untried.pop()
                last = taken[-1] if taken else self.start
                choice = matches[place]
        return taken

    def _encode_short(self, raw: bytes) -> list[int]:
        """The same search for a short chunk: a token is looked up when its turn comes."""
        ranks, reach, fits, fitting, size = self.ranks, self.reach, self.fits, self.fitting, len(raw)
        dead = bytearray(size + 1)
        taken: list[int] = []
        shorter: list[int] = []  # the longest end not yet tried behind the place of each token taken
        place, last = 0, self.start
        end = min(size, reach.get(raw[:PREFIX], PREFIX - 1))
        while place < size:
            while end > place:
                token = ranks.get(raw[place:end])
                if token is not None and not dead[end]:
                    fit = fitting.get(last << 32 | token)
                    if fits(last, token) if fit is None else fit:
                        taken.append(token)
                        shorter.append(end - 1)
                        place, last = end, token
                        end = min(size, place + reach.get(raw[place : place + PREFIX], PREFIX - 1))
                        break
                end -= 1
            else:
                dead[place] = 1
                place -= self.length[taken.pop()]
                end = shorter.pop()
                last = taken[-1] if taken else self.start
        return taken

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are when they meet; remembered."""
        if len(self.fitting) >= KEPT:
            self.fitting.clear()
        fit = self.fitting[last << 32 | token] = self._fits(last, token)
        return fit

    def _fits(self, last: int, token: int) -> bool:
        """Take the merges inside the two back, the later one first, and look at what then meets at the border.

        A merge over the border comes first if its rank is below that of the
        merge taken back; of equal ranks the one more to the left comes first.
        """
        if last == self.start:
            return True
        ranks, tokens, before = self.ranks, self.tokens, _NEVER
        while True:
            if ranks.get(tokens[last] + tokens[token], _NEVER) < before:
                return False
            left, right = self.halves[last], self.halves[token]
            if left and (last > token or not right):
                before, last = last, left[1]
            elif right:
                before, token = token + 1, right[0]
            else:
                return True

    def _halves(self, raw: bytes) -> tuple[int, ...] | None:
        """The two tokens that the last merge puts together; none for a byte; None if merges of lower rank don't get so far."""
        parts = merged(raw, self.ranks, self.ranks[raw]) if len(raw) > 1 else []
        return tuple(self.ranks[p] for p in parts) if len(parts) in (0, 2) else None


def encode(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """Add ``ids``, the token numbers of ``text`` as little-endian unsigned 32-bit integers, to every row.

    ``ranks`` is a file that executors can open and that holds every single
    byte.  Texts are encoded whole; NULL counts as empty, an empty text has
    no tokens and so an empty ``ids``.  Strings of special tokens are plain text.
    Other columns pass through, a column ``ids`` is replaced; repeated rows stay.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        return [kept(("byte_bpe", ranks, pattern), lambda: Encoder(ranks, pattern)).encode_all(texts)]

    return with_columns(docs, run, "ids binary", arrow=True)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` stand for; NULL ``ids`` give NULL, empty ones no bytes.

    Any sequence of known numbers has bytes, though not always those of UTF-8
    text; an unknown number fails.  Other columns pass through, a column
    ``decoded`` is replaced.
    """

    def run(all_ids: list[bytes | None]) -> list[pa.Array]:
        token = _tokens(ranks).__getitem__
        return [pa.array([None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist())) for ids in all_ids], pa.binary())]

    return with_columns(encoded, run, "decoded binary", column="ids")


@lru_cache(maxsize=1)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}
