"""Near-duplicates by SimHash, found with a self-join over a binary trie.

Fingerprints that differ in at most ``budget`` of 64 bits agree in at least one
of ``budget + 1`` blocks of bits.  Each fingerprint is therefore put into that
many tries, each beginning with another block; the first levels of a trie allow
no error and are an equi-join key, below them tasks walk pairs of nodes
together, add up the bits that differ and leave a pair of nodes as soon as the
budget is exceeded.  Copies fall together before the join, and a fingerprint
has at most ``1 + 64 + 2016`` others within two bits, so the walk is linear in
the number of different fingerprints however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import bounded_batches, by_batch, with_columns
from seriata.llm.components import components
from seriata.session import settle

SHINGLE = 3
BUDGET = 2
SEED = 42
GROUP = 8192  # fingerprints under one node of the first levels, above which it is cut further
FRONTIER = 1 << 20  # pairs of nodes walked at once
CHUNK = 1 << 16  # fingerprints walked at once, and shingles counted at once

_NO_DOC = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the words of a UTF-8 text; 0 without words.

    A-Z is lower-cased, white space is space, tab and the four line breaks of
    ASCII.  A bit is set if more than half the shingles, repeats included, set it.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest, n, ones = xxhash.xxh64_intdigest, len(words) - shingle + 1, np.zeros(64, np.int64)
    for begin in range(0, n, CHUNK):
        part = min(CHUNK, n - begin)
        hashes = np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(part))), "<u8", part)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(part, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long)`` of every row of ``docs(doc_id, text)``; a NULL text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], "<u8")
        return pa.record_batch([batch.column(0), pa.array(out.view("<i8"))], ["doc_id", "fp"])

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return by_batch(text, run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Add ``fingerprint`` (16 hexadecimal digits) to ``docs(text, ...)``."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([f"{fingerprint((t or '').encode(), shingle):016x}" for t in texts], pa.string())]

    return with_columns(docs, run, "fingerprint string")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most ``budget`` bits are linked;
    ``component_id`` is the smallest ``doc_id`` that links lead to.  Empty and
    NULL texts have the fingerprint zero and are linked like any other.  A row
    without ``doc_id`` is kept and names no component: its ``component_id`` is
    NULL only if no row of the component has a number.  Repeated rows stay.
    Other columns are ignored; an empty table gives no rows.
    """
    marked = settle(fingerprints(docs, shingle))
    different = settle(
        marked.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_DOC)).alias("first"))
    )
    found = components(trie_links(different, budget)).select(
        F.col("node.fp").alias("fp"), F.col("root.first").alias("root")
    )
    classes = settle(
        different.join(found, "fp", "left").select(
            "fp", F.nullif(F.coalesce("root", "first"), F.lit(_NO_DOC)).alias("component_id")
        )
    )
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def trie_links(different: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links ``(a, b)`` between vertices ``(first, fp)``: a spanning forest per task.

    ``different(fp, first)`` must hold each fingerprint once.
    """
    rows = _by_block(different, budget)
    bounded_batches(different.sparkSession)
    vertex = "struct<first: bigint, fp: bigint>"
    walked = (
        rows.repartition("block", "key", "pair")
        .sortWithinPartitions("block", "key", "pair", "turned")
        .mapInArrow(_walker(budget), f"a {vertex}, b {vertex}")
    )
    return walked


def _by_block(different: DataFrame, budget: int) -> DataFrame:
    """``(block, key, pair, turned, first)``: a fingerprint once per block and node pair.

    ``key`` is the block of bits that must agree.  A key with more than
    ``GROUP`` fingerprints is cut by the next bits into subtrees, and each
    fingerprint goes to the pairs of subtrees within the budget.
    """
    turns, widths = _blocks(budget)
    turned = F.array(
        *[
            F.struct(F.lit(i).alias("block"), _rotate("fp", t).alias("turned"), _top(_rotate("fp", t), w).alias("key"))
            for i, (t, w) in enumerate(zip(turns, widths))
        ]
    )
    rows = different.select(F.explode(turned).alias("t"), "first").select("t.*", "first")
    large = rows.groupBy("block", "key").count().where(F.col("count") > GROUP)
    deep = F.ceil(F.log2(F.col("count") / GROUP)).cast("int") + 2
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("block") + 1)
    cut = settle(large.select("block", "key", deep.alias("deep")))
    rows = rows.join(cut, ["block", "key"], "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    own = F.expr("shiftrightunsigned(shiftleft(turned, width), 64 - deep)")
    whole = rows.where("deep = 0").select("block", "key", F.lit("").alias("pair"), "turned", "first")
    parts = (
        rows.where("deep > 0")
        .withColumn("width", width)
        .withColumn("own", own)
        .withColumn("flip", F.explode(_flips("deep", budget)))
        .withColumn("other", F.col("own").bitwiseXOR(F.col("flip")))
        .select("block", "key", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "turned", "first")
    )
    return whole.unionByName(parts)


def _blocks(budget: int) -> tuple[list[int], list[int]]:
    """Where each block begins and how wide it is."""
    n = budget + 1
    ends = [64 * i // n for i in range(n + 1)]
    return ends[:-1], [b - a for a, b in zip(ends, ends[1:])]


def _rotate(column: str, by: int) -> Column:
    value = F.col(column)
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _top(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, 64 - bits)


def _flips(deep: str, budget: int) -> Column:
    """All numbers below 2**deep with at most ``budget`` bits set."""
    most = 64 - min(_blocks(budget)[1])
    masks = [sum(1 << b for b in c) for k in range(budget + 1) for c in combinations(range(most), k)]
    return F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m < F.expr(f"shiftleft(1L, {deep})"))


def _walker(budget: int):
    turns, widths = _blocks(budget)
    skip = min(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks()
                begins = _begins(rows)
                last = int(begins[-1])
                if last:
                    yield from links(rows.slice(0, last), begins[:-1])
                held = rows.slice(last).combine_chunks().to_batches()
                n = rows.num_rows - last
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from links(rows, _begins(rows))

    def links(rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        turned = rows["turned"].to_numpy().view("<u8")
        first, block = rows["first"].to_numpy(), rows["block"].to_numpy()
        root = np.arange(len(turned))
        for i, j in walk(turned, begins, budget, skip):
            root = merge(root, i, j)
        i = np.flatnonzero(root != np.arange(len(root)))
        if len(i):
            back = np.array(turns, "<u8")[block]
            fp = (turned >> back) | (turned << ((64 - back) % 64))
            fp = fp.view("<i8")
            side = [
                pa.StructArray.from_arrays([pa.array(first[k]), pa.array(fp[k])], ["first", "fp"])
                for k in (i, root[i])
            ]
            yield pa.record_batch(side, ["a", "b"])

    return run


def _begins(rows: pa.Table) -> np.ndarray:
    """Where each group of (block, key, pair) begins."""
    block, key = rows["block"].to_numpy(), rows["key"].to_numpy()
    pair = rows["pair"].combine_chunks().dictionary_encode()
    code = (pair.chunk(0) if isinstance(pair, pa.ChunkedArray) else pair).indices.to_numpy()
    new = (np.diff(block) != 0) | (np.diff(key) != 0) | (np.diff(code) != 0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def walk(
    values: np.ndarray, begins: np.ndarray, budget: int, skip: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)`` of values of one group that differ in at most ``budget`` bits.

    Values are unsigned, sorted inside each group, and agree in their first
    ``skip`` bits or were cut below them.  A node of the trie is a range of
    values; pairs of nodes go down together, level by level.
    """
    ends = np.append(begins[1:], len(values))
    alone = np.stack([begins, ends])[:, ends - begins > 1]
    stack = [(skip, alone, np.empty((5, 0), np.int64))]
    while stack:
        depth, alone, pairs = stack.pop()
        if depth == 64 or not (alone.shape[1] or pairs.shape[1]):
            continue
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, alone[:, :0], pairs[:, :half]), (depth, alone, pairs[:, half:])]
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        low, high = alone
        middle = high - (ones[high] - ones[low])
        split = (low < middle) & (middle < high)
        born = np.stack([low, middle, middle, high, np.ones_like(low)])[:, split] if budget else pairs[:, :0]
        alone = np.concatenate([np.stack([low, middle]), np.stack([middle, high])], 1)
        alone = alone[:, alone[1] - alone[0] > 1]
        a0, a2, b0, b2, bits = pairs
        a1, b1 = a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0])
        pairs = np.concatenate(
            [
                born,
                np.stack([a0, a1, b0, b1, bits]),
                np.stack([a1, a2, b1, b2, bits]),
                np.stack([a0, a1, b1, b2, bits + 1]),
                np.stack([a1, a2, b0, b1, bits + 1]),
            ],
            1,
        )
        pairs = pairs[:, (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget)]
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        i, j = pairs[0, single], pairs[2, single]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        if near.any():
            yield i[near], j[near]
        stack.append((depth + 1, alone, pairs[:, ~single]))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of ``i`` and ``j``; every place points at the smallest of its tree."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
