"""Near copies: classes of texts whose sets of five words in a row are alike.

Two texts are linked if the Jaccard similarity of their sets is at least 0.8;
every such pair is reached, for sets that alike share a shingle among the
``n // 5 + 1`` first of each in any order common to all (Chaudhuri and others,
"A primitive operator for similarity joins", 2006).  Rare shingles come first.
The texts that share a shingle are compared with the first of them, then with
more and more of them; pairs already in one class need no comparison, so a
large group of copies costs a few comparisons each.  Each link is confirmed on
the whole sets.  Links that are known before, such as those of fingerprints,
belong to the classes too and spare comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm import simhash
from seriata.llm.common import bounded_batches, by_batch, with_columns
from seriata.llm.components import components
from seriata.llm.workers import release
from seriata.session import settle

SHINGLE = 5
SEED = 42
SLOTS = 1 << 18  # counters for the order of shingles; any number gives the same classes
LEADERS = (1, 16)  # texts of a shingle that the others are compared with: first time, second; then four times more

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "<u8")


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the different shingles of a UTF-8 text, sorted; fewer than five words are one shingle.

    Letters and white space are those of ``simhash.fingerprint``.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(w, SEED) for w in words), "<u8", len(words))
    mixed = sum(hashes[i : i + n] * _MIX[i] for i in range(SHINGLE))
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _MIX[0])


def set_number(found: np.ndarray) -> int:
    """The number of a set of shingles; 0 for the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0


def with_class(docs: DataFrame, name: str = "class", known: DataFrame | None = None) -> DataFrame:
    """Add the class, a number, to every row of ``docs(text, ...)``; NULL and texts without words are one class.

    ``known(a, b)`` are links between numbers of sets that join classes whatever the sets share.
    """

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([set_number(shingles((t or "").encode())) for t in texts], pa.int64())]

    marked = with_columns(docs, run, f"{name} long")
    roots = classes(docs, known).select(F.col("node").alias(name), "root")
    rows = marked.join(roots, name, "left").withColumn(name, F.coalesce("root", name))
    return rows.select(*docs.columns, name)


def fingerprint_links(docs: DataFrame) -> DataFrame:
    """``(a, b)`` between the numbers of sets of ``docs(text, ...)`` whose SimHash fingerprints the trie links.

    Sets of one fingerprint are linked to the smallest of them; a spanning
    forest stands for all links between different fingerprints.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        texts = [t or b"" for t in batch.column(0).to_pylist()]
        nodes = [set_number(shingles(t)) for t in texts]
        found = np.array([simhash.fingerprint(t) for t in texts], "<u8").view("<i8")
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(found)], ["node", "fp"])

    marked = settle(by_batch(docs.select(F.col("text").cast("binary")), run, "node long, fp long").distinct())
    different = settle(marked.groupBy("fp").agg(F.min("node").alias("first")))
    own = marked.join(different, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return own.union(simhash.trie_links(different).select("a.first", "b.first"))


def classes(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, root)``: the sets linked to others, and the smallest set number of their class."""
    text = docs.select(F.col("text").cast("binary"))
    bounded_batches(docs.sparkSession)
    heads = settle(_heads(text, _counts(text)).dropDuplicates(["node"]))
    entries = heads.select("node", "n", F.posexplode("head").alias("place", "shingle"))
    shared = entries.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    members = settle(entries.join(shared.select("shingle"), "shingle"))
    sets = settle(_sets(text).join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = none if known is None else settle(components(known))
    leaders, more = LEADERS
    while not members.isEmpty():
        order = Window.partitionBy("shingle").orderBy("node")
        first = settle(members.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= leaders).drop("__rank"))
        here = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        led = first.join(roots, "node", "left").select(
            "shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.coalesce("root", "node").alias("root_a")
        )
        # what can still be shared behind the two places must be enough for 0.8
        reach = "9L * least(n_a - place_a, n - place) >= 4L * (n_a + n)"
        pairs = settle(
            here.join(led, "shingle")
            .where(f"a < node AND root_a <> root AND {reach}")
            .select("a", F.col("node").alias("b"))
            .distinct()
        )
        found = settle(_confirmed(pairs, sets).union(roots.toDF("a", "b")))
        roots = settle(components(found))
        rest = settle(
            members.join(first.select("shingle", "node"), ["shingle", "node"], "left_anti")
            .join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node"))
        )
        apart = rest.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        members = settle(rest.drop("root").join(apart.select("shingle"), "shingle"))
        leaders, more = more, 4 * more
    return roots


def _counts(text: DataFrame) -> np.ndarray:
    """How many shingles fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(counts, (shingles(t or b"") % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    total = text.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[total["slot"].to_numpy()] = total["n"].to_numpy()
    return counts


def _heads(text: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(node, n, head)``: a set's number, its size and its rarest ``n // 5 + 1`` shingles, rarest first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()
        nodes, sizes, heads = [], [], []
        for t in batch.column(0).to_pylist():
            found = shingles(t or b"")
            seldom = np.argsort(counts[(found % np.uint64(SLOTS)).astype(np.int64)], kind="stable")
            nodes.append(set_number(found))
            sizes.append(len(found))
            heads.append(found[seldom[: len(found) // 5 + 1]])
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(heads)], ["node", "n", "head"])

    return by_batch(text, run, "node long, n long, head array<long>")


def _sets(text: DataFrame) -> DataFrame:
    """``(node, found)`` of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t or b"") for t in batch.column(0).to_pylist()]
        return pa.record_batch([pa.array([set_number(s) for s in sets], pa.int64()), _lists(sets)], ["node", "found"])

    return by_batch(text, run, "node long, found array<long>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, "<u8"), *parts]).view("<i8")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach 0.8, in whole numbers."""
    one = sets.select(F.col("node").alias("b"), F.col("found").alias("set_b"))
    other = sets.select(F.col("node").alias("a"), F.col("found").alias("set_a"))
    both = pairs.join(one, "b").join(other, "a").select("a", "b", "set_a", "set_b")
    alike = "9L * size(array_intersect(set_a, set_b)) >= 4L * (size(set_a) + size(set_b))"
    return both.where(alike).select("a", "b")
