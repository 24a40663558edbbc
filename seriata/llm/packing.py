"""Packing of tokenized documents into sequences by sums of squares.

A document goes where the sum of the squared numbers of open sequences per
residual gap becomes smallest (Csirik and others, "On the sum-of-squares
algorithm for bin packing", 2006).  Documents are dealt by a number of their own,
so that copies do not meet, into groups that are packed apart, the long ones
first; what the groups' last sequences could not fill is packed once more, in
fewer groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import by_batch
from seriata.llm.tokens import KEPT, WordTokenizer
from seriata.llm.workers import kept
from seriata.session import settle

LENGTH = 2048
GROUP = 4096  # documents packed together
END = 0  # the number behind each document

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _tokenizer(path: str, remember: int) -> WordTokenizer:
    return kept(("words", path, remember), lambda: WordTokenizer(path, remember))


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False, remember: int = KEPT
) -> DataFrame:
    """Documents as token numbers, the longer ones cut every ``length`` tokens.

    ``docs(doc_id, text)`` gives ``doc_id, piece, start, length, ids_crc32`` and,
    if kept, ``ids``.  A NULL or empty text is the end number alone.  Repeated
    rows, and rows without ``doc_id``, are documents of their own; other
    columns are ignored.  ``tokenizer`` must be a path that executors can open;
    a worker remembers up to ``remember`` words, which costs memory and spares time.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows: list[tuple] = []
        end = np.array([END], "<u4").tobytes()
        for i, numbers in enumerate(_tokenizer(tokenizer, remember).encode(texts)):
            raw = numbers + end
            for piece, at in enumerate(range(0, len(raw), 4 * length)):
                part = raw[at : at + 4 * length]
                rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
        row, piece, start, size, crc, parts = zip(*rows)
        ids = [p if p is None else np.frombuffer(p, "<i4") for p in parts]
        return pa.record_batch(
            [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
            ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
        )

    found = by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)
    return found if keep_ids else found.drop("ids")


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Place pieces into sequences of at most ``length`` tokens.

    Adds ``sequence_id`` and ``offset`` to ``cut(doc_id, piece, start, length,
    ids_crc32)``; a sequence has no gaps and begins at 0.  Equal rows are pieces
    of their own, spread over all groups; without rows there is no sequence.
    Runs jobs: the pieces are counted, and what stays open is packed again.
    """
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def dealt(rows: DataFrame, groups: int, *number: str) -> DataFrame:
        return rows.select(*own, F.pmod(F.xxhash64(*number), F.lit(groups)).alias("__group"))

    # The number is written with the row: it stays the same whatever is computed again.
    keys = settle(cut.select(*own, F.monotonically_increasing_id().alias("number")))
    first = max(1, -(-keys.count() // group))
    packed = settle(_pack_groups(dealt(keys, first, "number"), length, 0))
    closed = packed.where("full").drop("full")
    if first == 1:
        return packed.drop("full")
    left = packed.where("NOT full")
    fewer = max(1, -(-left.count() // group))
    again = dealt(left, fewer, "sequence_id", "offset")  # one piece lies there
    return closed.unionByName(_pack_groups(again, length, first).drop("full"))


def _pack_groups(rows: DataFrame, length: int, begin: int) -> DataFrame:
    """Pack each group; ``full`` is false in sequences that leave more than a sixteenth open."""

    def run(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start"))]
        rows = rows.sort_by(order)
        sizes = rows["length"].to_numpy()
        number, offset = place(sizes, length)
        full = np.bincount(number, sizes)[number] >= length - length // 16
        group = begin + rows["__group"][0].as_py()
        columns = [*rows.drop(["__group"]).columns, pa.array(number + (group << 32)), pa.array(offset), pa.array(full)]
        return pa.table(columns, [*rows.drop(["__group"]).column_names, "sequence_id", "offset", "full"])

    return rows.groupBy("__group").applyInArrow(run, PLACED + ", full boolean")


def place(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size, in the order given.

    Among the sequences in which it fits, a size takes the gap that makes the
    sum of squares smallest, the tighter one of equals; it opens a sequence
    only if it fits nowhere.
    """
    count = np.zeros(length + 1)
    gaps: list[list[int]] = [[] for _ in range(length + 1)]
    number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for i, size in enumerate(sizes.tolist()):
        change = 2 * (count[: length + 1 - size] - count[size:] + 1)  # by what is left over
        change[0] = 1 - 2 * count[size]  # a full sequence counts no more
        change[count[size:] == 0] = np.inf
        left = int(np.argmin(change))
        if change[left] == np.inf:
            gap, own, opened = length, opened, opened + 1
            left = length - size
        else:
            gap = left + size
            own = gaps[gap].pop()
            count[gap] -= 1
        if left:
            gaps[left].append(own)
            count[left] += 1
        number[i], offset[i] = own, length - gap
    return number, offset


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token numbers of each sequence, put together.

    ``cut`` are the ``pieces`` with their ``ids``.  Equal pieces are told apart
    by their place in any order, as they hold the same numbers.
    """
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))
    left, right = cut.withColumn("copy", copy), placed.withColumn("copy", copy)
    on = [left[c].eqNullSafe(right[c]) for c in (*same, "copy")]
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = left.join(right, on).select("sequence_id", "offset", "ids")
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
