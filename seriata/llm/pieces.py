"""Encoding into the pieces of a given SentencePiece model, and back.

No piece reaches over a space, so a text is a row of words.  The different words
of a batch are encoded once each, as arrays of their letters: a walk down the
trie of the pieces from every letter at once finds the edges of the words'
lattices.  The model merges pairs by rank, which a Viterbi search for the largest
sum of scores would not reproduce, so the fold over the edges goes by rank: an
edge is taken if it covers exactly two of the pieces that stand by then.
Characters without a piece become the pieces of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm.common import by_batch, joined
from seriata.llm.workers import release

SPACE = "▁"
MOST = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
FIRST_BYTE = 3  # number of the piece of byte 0; those of the other bytes follow
LETTERS = 1 << 17  # of words that are encoded together, about: their edges are held at once
TOGETHER = 64  # the fold goes on word by word where fewer have edges left


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """``(id, piece, score, bytes)`` of a model file; ``score`` is NULL for pieces that texts cannot spell.

    ``bytes`` is what a piece stands for, as hexadecimal digits.  Fails for a
    model with a piece that goes on behind a space, or with more than ``MOST``
    pieces: the table is broadcast.
    """
    loaded = sentencepiece.SentencePieceProcessor(model_file=model)
    if loaded.get_piece_size() > MOST:
        raise ValueError(f"more than {MOST} pieces")
    rows = []
    for i in range(loaded.get_piece_size()):
        piece = loaded.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {i} goes on behind a space")
        if loaded.is_byte(i):
            rows.append((i, piece, None, piece[3:5]))
        elif loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i):
            rows.append((i, piece, None, ""))
        else:
            rows.append((i, piece, loaded.get_score(i), piece.encode().hex().upper()))
    return spark.createDataFrame(rows, "id int, piece string, score double, bytes string")


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text with the spaces before them; one space is put before a text that is not empty."""
    texts = pc.fill_null(texts, "")
    marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), "")
    marked = pc.if_else(pc.equal(texts, ""), "", marked)
    _, at, data = marked.buffers()
    at = np.frombuffer(at, np.int32)[marked.offset : marked.offset + len(marked) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[: at[-1]]
    first, *rest = SPACE.encode()
    space = np.flatnonzero(raw == first)
    for i, byte in enumerate(rest, 1):
        space = space[raw[space + i] == byte]
    begins = np.diff(space, prepend=-9) != 1 + len(rest)  # not right behind another space
    begins[np.searchsorted(space, at[:-1][np.diff(at) > 0])] = True
    places = space[begins]
    cut = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(np.append(places, at[-1]).astype(np.int32)), data])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, at).astype(np.int32)), cut)


class Lattice:
    """The pieces of a table ``(id, piece, score, bytes)``: a trie over their letters, their order and their bytes."""

    def __init__(self, table: pa.Table):
        spelled = [r for r in table.to_pylist() if r["score"] is not None and r["piece"]]
        letters = sorted({letter for r in spelled for letter in r["piece"]})
        self.step = len(letters) + 1
        number = {letter: i for i, letter in enumerate(letters)}
        self.number = np.full(max(map(ord, letters), default=0) + 2, -1, np.int32)  # the last for all letters behind
        self.number[[*map(ord, letters)]] = np.arange(len(letters))
        children: dict[int, int] = {}  # of node * step + letter
        ends = [-1]  # the piece that ends at a node
        for r in spelled:
            node = 0
            for letter in r["piece"]:
                node = children.setdefault(node * self.step + number[letter], len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = r["id"]
        self.ends = np.array(ends, np.int32)
        # the node and the piece of each letter alone; the last for letters of no piece
        self.first = np.array([children.get(i, 0) for i in range(self.step)], np.int32)
        self.alone = self.ends[self.first]
        # paths and their nodes by hash, at the first free slot from there on; at most a quarter is taken
        bits = (4 * len(children) + 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.paths, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        paths = np.fromiter(children, np.int64, len(children))
        for path, node, slot in zip(paths.tolist(), children.values(), self._slots(paths).tolist()):
            while self.paths[slot] >= 0:
                slot = (slot + 1) % len(self.paths)
            self.paths[slot], self.nodes[slot] = path, node
        most = pc.max(table["id"]).as_py() or 0
        self.rank = np.zeros(most + 1, np.int64)  # equal scores have equal ranks
        if spelled:
            self.rank[[r["id"] for r in spelled]] = np.unique([-r["score"] for r in spelled], return_inverse=True)[1]
        known = [b""] * (most + 2)  # the last for numbers that are no piece
        for r in table.to_pylist():
            known[r["id"]] = bytes.fromhex(r["bytes"])
        self.bytes = pa.array(known, pa.binary())

    def encode(self, lists: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
        """The piece numbers of each list of words put together, and whether those of each word spell it."""
        words, at = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        at, codes = at - at[0], words.indices.to_numpy()
        parts = [self._portion(part) for part in _portions(words.dictionary)]
        numbers = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(part[0] for part in parts)]).take(words.indices)
        right = np.concatenate([np.zeros(0, bool), *(part[1] for part in parts)])
        wrong = np.append(0, np.cumsum(~right[codes]))[at]
        ends = numbers.offsets.to_numpy()
        found = pa.ListArray.from_arrays(pa.array(ends[at] - ends[0]), numbers.flatten())
        return found, pa.array(wrong[1:] == wrong[:-1])

    def _portion(self, words: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The numbers of each word, and whether they spell it."""
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int32)[words.offset :]
        text = data.slice(at[0], at[len(words)] - at[0]).to_pybytes().decode()
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        bounds = np.append(0, np.cumsum(pc.utf8_length(words).to_numpy()))
        after, piece = self._fold(self.number[np.minimum(letters, len(self.number) - 1)], bounds)

        stand = np.flatnonzero(after[:-1] >= 0)
        ids, ends = piece[stand], np.searchsorted(stand, bounds)
        alone = np.flatnonzero(ids < 0)
        if len(alone):
            odd = letters[stand[alone]]
            size = np.ones(len(ids), np.int64)
            size[alone] += (odd >= 0x80).astype(np.int64) + (odd >= 0x800) + (odd >= 0x10000)
            ids, ends = np.repeat(ids, size), np.append(0, np.cumsum(size))[ends]
            raw = odd.tobytes().decode("utf-32-le").encode()
            ids[ids < 0] = np.frombuffer(raw, np.uint8).astype(np.int32) + FIRST_BYTE
        ends = ends.astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), self._spelled(ids, ends, words)

    def _edges(self, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of each piece of two letters or more that lies in a word; short ones first."""
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(letters))
        node, size = self.first[letters], 1
        start = np.flatnonzero((node > 0) & (left > 1))
        node = node[start]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(start):
            letter = letters[start + size]
            node = self._child(node * np.int64(self.step) + letter)
            on = np.flatnonzero((node > 0) & (letter >= 0))
            start, node, size = start[on], node[on], size + 1
            ended = self.ends[node]
            hit = np.flatnonzero(ended >= 0)
            found.append((start[hit], start[hit] + size, ended[hit]))
            on = np.flatnonzero(left[start] > size)
            start, node = start[on], node[on]
        none = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip((none, none, none.astype(np.int32)), *found)))

    def _slots(self, paths: np.ndarray) -> np.ndarray:
        return ((paths.view("<u8") * _MIX) >> self.shift).view("<i8")

    def _child(self, paths: np.ndarray) -> np.ndarray:
        """The node at the end of each path, 0 if there is none."""
        slot = self._slots(paths)
        met = self.paths[slot]
        todo = np.flatnonzero((met != paths) & (met >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.paths)
            met[todo] = self.paths[slot[todo]]
            todo = todo[(met[todo] != paths[todo]) & (met[todo] >= 0)]
        return np.where(met == paths, self.nodes[slot], 0)

    def _fold(self, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the piece that begins at a letter ends, -1 if none begins there, and its number, -1 if it has none.

        The edges of a word go by rank, of equal ranks the one more to the left
        first.  All words take their first edge together, then the second.
        """
        start, end, number = self._edges(letters, bounds)
        word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[start]
        order = np.lexsort((start, word * len(self.rank) + self.rank[number]))
        start, end, number, word = start[order], end[order], number[order], word[order]

        after = np.append(np.arange(1, len(letters) + 1), -1)
        piece = self.alone[letters]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        count = np.diff(np.append(first, len(word)))
        longest = np.argsort(-count, kind="stable")
        first, count = first[longest], -count[longest]
        turn, active = 0, len(first)
        while active >= TOGETHER:
            edge = first[:active] + turn
            middle = after[start[edge]]
            taken = np.flatnonzero(after[middle] == end[edge])
            edge, middle = edge[taken], middle[taken]
            after[start[edge]] = end[edge]
            after[middle] = -1
            piece[start[edge]] = number[edge]
            turn += 1
            active = int(np.searchsorted(count, -turn))
        for i, n in zip(first[:active].tolist(), count[:active].tolist()):
            rest, own = slice(i + turn, i - n), slice(bounds[word[i]], bounds[word[i] + 1])
            links, numbers = after[own.start : own.stop + 1].tolist(), piece[own].tolist()
            for a, b, edge in zip((start[rest] - own.start).tolist(), end[rest].tolist(), number[rest].tolist()):
                middle = links[a] - own.start
                if links[a] >= 0 and links[middle] == b:
                    links[a], links[middle], numbers[a] = b, -1, edge
            after[own], piece[own] = links[:-1], numbers
        return after, piece

    def _spelled(self, ids: np.ndarray, ends: np.ndarray, words: pa.Array) -> np.ndarray:
        """Whether the bytes of its numbers are those of each word."""
        parts = self.bytes.take(pa.array(np.minimum(ids, len(self.bytes) - 1)))
        return pc.equal(joined(parts, ends), words.cast(pa.binary())).to_numpy(zero_copy_only=False)


def _portions(words: pa.Array) -> Iterator[pa.Array]:
    """The words in parts of ``LETTERS`` letters, about."""
    if len(words):
        part = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64)) // LETTERS
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, [*first[1:], len(words)]):
            yield words.slice(a, b - a)


def _bytes(parts: str) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda p: p["bytes"]), "")).cast("string")


def decode(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, decoded)``: the text that ``rows(doc_id, ids)`` spell, for every row.

    NULL or no numbers spell the empty text; numbers that are no piece spell
    nothing.  Repeated rows, and rows without ``doc_id``, stay.
    """
    keyed = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    parts = F.array_sort(F.collect_list(F.struct("place", "bytes")))
    text = (
        keyed.distinct()
        .select("doc_id", "ids", F.posexplode("ids").alias("place", "id"))
        .join(F.broadcast(table.select("id", "bytes")), "id")
        .groupBy(F.col("doc_id").alias("__doc_id"), F.col("ids").alias("__ids"))
        .agg(parts.alias("parts"))
        .select("__doc_id", "__ids", _text(_bytes("parts")).alias("decoded"))
    )
    same = keyed["doc_id"].eqNullSafe(text["__doc_id"]) & (keyed["ids"] == text["__ids"])
    return keyed.join(text, same, "left").select("doc_id", F.coalesce("decoded", F.lit("")).alias("decoded"))


def encode(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, ids, spelled)`` of every row of ``docs(doc_id, text)``.

    ``spelled``: whether the numbers of each of its words spell that word.  A
    NULL or empty text has no pieces.  Repeated rows, and rows without
    ``doc_id``, stay; other columns are ignored.  No row is shuffled: the
    pieces, ``MOST`` at most, are sent to the tasks.  The edges of a word are held
    and sorted at once; the time for it grows little faster than its length.
    """
    lattice = Lattice(table.select("id", "piece", "score", "bytes").toArrow())
    sent = docs.sparkSession.sparkContext.broadcast(lattice)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        return pa.record_batch([batch.column(0), *sent.value.encode(words(batch.column(1)))], ["doc_id", "ids", "spelled"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, spelled boolean")


def _text(joined: Column) -> Column:
    """Spaces for their marks, without the one put before the text."""
    return F.substring(F.replace(joined, F.lit(SPACE), F.lit(" ")), 2, 2147483647)
