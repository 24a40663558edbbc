"""Reading the tables, batches of bounded size, and rows that tasks exchange with Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch; a batch ends at ``BATCH_BYTES``.

    The size of a batch is a setting of the session, so it is set there: with
    the default, ten thousand very long texts would be one batch.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (function(batch) for batch in batches if batch.num_rows)

    return df.mapInArrow(run, schema)


def with_columns(
    docs: DataFrame, function: Callable[..., list[pa.Array]], added: str, column: str = "text", arrow: bool = False
) -> DataFrame:
    """Add the columns ``added`` (a schema) that ``function`` makes of the texts of a batch, a list or an Arrow array.

    Other columns pass through; those with a name that is added are replaced.
    """
    names = [field.strip().split(" ")[0] for field in re.split(r",\s*(?![^<]*>)", added)]
    docs = docs.drop(*names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(column))
        return pa.record_batch([*batch.columns, *function(texts if arrow else texts.to_pylist())], [*batch.schema.names, *names])

    return by_batch(docs, run, f"{kept}, {added}")


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What single spaces part in all texts, and where each text's words begin and end; NULL counts as empty."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()


def joined(parts: pa.Array, at: np.ndarray) -> pa.Array:
    """The bytes of the parts between each two places, put together."""
    _, ends, data = parts.buffers()
    ends = np.frombuffer(ends, np.int32)[at]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends), data])


def replaced(column: pa.Array, rows: np.ndarray, values: list[bytes]) -> pa.Array:
    """The column with other values in some rows."""
    if not len(rows):
        return column
    place = np.arange(len(column))
    place[rows] = len(column) + np.arange(len(rows))
    return pa.concat_arrays([column, pa.array(values, column.type)]).take(pa.array(place))


def stretch(text: str, chars: int) -> Column:
    """The text, or of a longer one ``chars`` characters in a row from a place fixed by its hash."""
    free = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(F.col(text), F.pmod(F.xxhash64(text), free).cast("int") + 1, F.lit(chars))


def bounded_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def doc_crc(doc_id: str = "doc_id"):
    """crc32 of the document's number written as text; 0 where there is none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def fixed_sample(df: DataFrame, by: str, n: int, *, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """A fixed choice of about ``n`` rows of each value of ``by``: those with the smallest hashes of ``key``.

    Rows of one key count once and one of them is given.  Only a number per
    value of ``by`` is gathered, so there must be few; no row of ``df`` is
    shuffled but the chosen ones.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*key))
    share = F.lit(float(n)) / F.approx_count_distinct("__hash", 0.02)
    last = hashed.groupBy(by).agg(((F.least(share, F.lit(1.0)) - 0.5) * 2.0**64).alias("__last"))
    chosen = hashed.join(F.broadcast(last), by).where(F.col("__hash") <= F.col("__last"))
    return chosen.dropDuplicates([by, "__hash"]).select(*df.columns)
