"""Vectors for the two searches: which take part, copies put together, blocks of bounded size, ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(embedding: str) -> Column:
    """True for a vector without NULL, NaN or infinite components; an empty one is none."""
    value = F.col(embedding)
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(value) > 0) & fine, F.lit(False))


def same_length(df: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vectors have the commonest number of components, the larger one of equals."""
    sizes = df.groupBy(F.size(embedding).alias("size")).count()
    most = sizes.agg(F.max_by("size", F.struct("count", "size"))).first()[0]
    return df.where(F.size(embedding) == F.lit(most))


def different(df: DataFrame, key: str, embedding: str, keep: int) -> DataFrame:
    """``(ids, vec)``: each vector once, with the ``keep`` smallest numbers of its rows.

    A list of the best ``keep - 1`` rows cannot need more of equal vectors.
    Repeated rows count once: they fall together before they are ranked.  Both
    are cut on the side of the scan, so copies are not gathered.
    """
    order = Window.partitionBy(embedding).orderBy(key)
    once = df.select(key, embedding).distinct()
    ranked = once.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= keep)
    return ranked.groupBy(F.col(embedding).alias("vec")).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    flat = pa.chunked_array(column.chunks, column.type).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def block_search(
    members: DataFrame, queries: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], score: str
) -> DataFrame:
    """Run ``function(members, queries)`` on each block: ``(query_id, ids, score)`` of what it finds."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return function(left, right)
        return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], score_type)})

    score_type = pa.float64() if score == "double" else pa.int64()
    both = members.groupBy("block").cogroup(queries.groupBy("block"))
    return both.applyInArrow(run, f"query_id long, ids array<long>, score {score}")


def found_table(query: pa.ChunkedArray, ids: pa.ChunkedArray, at: np.ndarray, to: np.ndarray, score: np.ndarray) -> pa.Table:
    """Pairs of places in the queries and the members as rows of a result."""
    return pa.table({"query_id": query.take(pa.array(at)), "ids": ids.take(pa.array(to)), "score": pa.array(score)})


def least_score(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, least)``: the ``k``-th best score so far, NULL if there are fewer."""
    best = ranked(found, k)
    return best.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` rows other than the query's own, ties by number."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id")
        .dropDuplicates(["query_id", "vec_id"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
