"""Exact search of the largest inner products over vectors grouped by length.

After Teflioudi and others, "LEMP: fast retrieval of large entries in a matrix
product" (2015).  A first look at the longest vectors gives every query a score
that its list must reach.  In a bucket of vectors of nearly the same length that
score is a cosine: above 1 the query skips the bucket; if it is high, the
components in which the query is largest narrow the candidates down to ranges;
else candidates are those long enough.  What is left is multiplied exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.vectors import block_search, different, finite, found_table, least_score, matrix, ranked, same_length
from seriata.session import settle

SCALE = 1024
BUCKET = 2048  # vectors of a bucket, about
QUERIES = 4096  # queries that a bucket is searched with at once, about
STEEP = 0.6  # cosine from which components narrow the candidates down
FOCUS = 4  # components looked at
EDGES = 4096  # buckets at most by length alone; larger tables split buckets by hash

_EXACT = 2.0**53


def whole_numbers(embedding: str):
    """Components times 1024, rounded down; those beyond a long's range become its ends."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` largest inner products, all rows considered.

    ``rows(vec_id, embedding)`` and ``queries(vec_id, embedding)``; a query's own
    number is no candidate.  Scores are products of ``whole_numbers``, exact up
    to the range of a long, whose ends stand for what is beyond; ties go to the
    smaller number.  Vectors that are NULL, empty or hold a component that is
    NULL or not finite take no part, nor do rows without number and vectors not
    of the commonest length; zero vectors do.  A number that comes twice with
    one vector counts once.  Other columns are ignored.
    """
    usable = finite("embedding") & F.col("vec_id").isNotNull()
    pick = [F.col("vec_id").cast("long"), whole_numbers("embedding").alias("embedding")]
    rows = same_length(rows.where(usable).select(*pick), "embedding")
    asked = queries.where(usable).select(*pick).distinct()
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    members = settle(different(rows, "vec_id", "embedding", k + 1).withColumn("size", size))
    n, width = members.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n == 0:
        return ranked(rows.sparkSession.createDataFrame([], "query_id long, ids array<long>, score long"), k)
    asked = settle(asked.where(F.size("embedding") == F.lit(width)))
    turns = max(1, -(-asked.count() // QUERIES))

    buckets = max(1, min(EDGES, -(-n // BUCKET)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = members.agg(F.percentile_approx("size", shares, 20 * buckets)).first()[0] if shares else []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    place = F.size(F.filter(edges, lambda e: e < F.col("size")))
    placed = members.withColumn("place", place)
    parts = settle(
        placed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts"), F.max("size").alias("longest"))
    )
    top = parts.agg(F.max("place")).first()[0]
    dealt = (
        placed.join(F.broadcast(parts), "place")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        .select(F.struct("place", F.pmod(F.xxhash64("vec"), "parts").alias("part"), "turn").alias("block"), "place", "ids", "vec", "size")
    )
    long_enough = asked.select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("query"),
        F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int").alias("turn"),
    )

    def sought(of: DataFrame, least: DataFrame | None) -> DataFrame:
        """A row per query and part of a bucket that is long enough for it."""
        listed = of.agg(F.collect_list(F.struct("place", "parts", "longest")).alias("all")).first()[0]
        choice = F.array(*[F.struct(F.lit(b.place).alias("place"), F.lit(b.parts).alias("parts"), F.lit(b.longest).alias("longest")) for b in listed])
        with_least = long_enough.withColumn("least", F.lit(None).cast("long")) if least is None else long_enough.join(least, "query_id", "left")
        length = F.sqrt(F.aggregate("query", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        reach = F.coalesce(F.col("least").cast("double"), F.lit(-float("inf")))
        return (
            with_least.withColumn("b", F.explode(choice))
            .where(length * F.col("b.longest") * (1 + 1e-9) >= reach)
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.parts") - 1)))
            .select(F.struct(F.col("b.place").alias("place"), "part", "turn").alias("block"), "query_id", "query", "least")
        )

    near = settle(block_search(dealt.where(F.col("place") == top), sought(parts.where(F.col("place") == top), None), _products(k), "long"))
    rest = parts.where(F.col("place") < top)
    if buckets == 1 or rest.isEmpty():
        return ranked(near, k)
    more = block_search(dealt.where(F.col("place") < top), sought(rest, least_score(near, k)), _products(k), "long")
    return ranked(near.unionByName(more), k)


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond a long's range its ends."""
    most = float(np.abs(query.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0))
    if most * vectors.shape[1] < _EXACT:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    ends = np.iinfo(np.int64)
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), ends.min), ends.max) for x in exact], np.int64)


def candidates(unit: np.ndarray, cosine: float, directions: np.ndarray) -> np.ndarray:
    """Places of directions that may reach a cosine with ``unit``, by its largest components.

    Two angles to an axis differ by no more than the angle between the two.
    """
    apart = np.arccos(np.clip(cosine, -1.0, 1.0)) + 1e-7
    open_ = np.ones(len(directions), bool)
    for axis in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
        angle = np.arccos(np.clip(unit[axis], -1.0, 1.0))
        low, high = np.cos(min(np.pi, angle + apart)), np.cos(max(0.0, angle - apart))
        open_ &= (directions[:, axis] >= low - 1e-9) & (directions[:, axis] <= high + 1e-9)
    return np.flatnonzero(open_)


def _products(k: int):
    """The pairs of a bucket that reach a query's least score, its best ``k`` and one for itself."""

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        members = members.sort_by([("size", "descending")])
        vectors, sizes = matrix(members["vec"], np.int64), members["size"].to_numpy()
        directions = vectors / np.where(sizes > 0, sizes, 1.0)[:, None]
        asked = matrix(queries["query"], np.int64)
        at, to, scores = [], [], []
        for i, (query, least) in enumerate(zip(asked, queries["least"].to_pylist())):
            length = float(np.sqrt((query.astype(float) ** 2).sum()))
            some = np.arange(len(vectors))
            if least is not None and least > 0:
                if length == 0 or sizes[0] == 0:
                    continue
                cosine = least / (length * sizes[0]) * (1 - 1e-9)
                if cosine > 1:
                    continue
                if cosine >= STEEP:
                    some = candidates(query / length, cosine, directions)
                else:
                    some = some[: np.searchsorted(-sizes, -least / length * (1 - 1e-9), side="right")]
            if not len(some):
                continue
            score = products(query, vectors if len(some) == len(vectors) else vectors[some])
            most = min(k + 1, len(score))
            bound = np.partition(score, len(score) - most)[len(score) - most]
            best = np.flatnonzero(score >= (bound if least is None else max(bound, least)))
            at.append(np.full(len(best), i))
            to.append(some[best])
            scores.append(score[best])
        none = [np.zeros(0, np.int64)]
        return found_table(queries["query_id"], members["ids"], *map(np.concatenate, (none + at, none + to, none + scores)))

    return run
