"""Fixity of WARC archives: hash trees over records in the order of their offsets.

Records are leaves; a node hashes the hashes of the records, or nodes, of one
range of record numbers, and knows the offsets that the range takes.  Ranges are
by number, not by place, so that a lost or inserted record changes only the
branch it belongs to.  Replicas are compared from the root down, and only below
nodes that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.session import settle

FANOUT = 32
SEGMENT = 1024  # record numbers that one archive file holds

_LINE = "\r\n"


def warc_record(number: str, url: str, body: str) -> Column:
    """A WARC 1.1 resource record as text; NULLs are written as empty."""
    content = F.coalesce(F.col(body), F.lit(""))
    head = F.concat_ws(
        _LINE,
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col(number).cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col(url), F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
    )
    return F.concat(head, F.lit(_LINE + _LINE), content, F.lit(_LINE + _LINE))


def archive(pages: DataFrame) -> DataFrame:
    """Records of ``pages(page_id, url, html)``: ``number, file, offset, length, digest, copies``.

    A file holds the records of ``SEGMENT`` numbers, ordered by number and then
    digest.  Equal records are one row with the number of their copies; records
    without number go by their digest's hash.  Other columns are ignored.
    """
    record = warc_record("page_id", "url", "html")
    hashed = pages.select(F.col("page_id").cast("long").alias("number"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    hashed = hashed.withColumn("number", F.coalesce("number", F.xxhash64("digest")))
    once = hashed.groupBy("number", "digest", "length").agg(F.count(F.lit(1)).alias("copies"))
    placed = once.withColumn("file", F.floor(F.col("number") / SEGMENT))
    order = Window.partitionBy("file").orderBy("number", "digest")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0).cast("long")))


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up, each ``(node, hash, from, to)`` of one archive; ``from`` and ``to`` are offsets.

    A leaf is a record number, so several records of one number are hashed together.
    """
    entry = F.struct("digest", "length", "copies")
    leaves = records.groupBy(F.col("number").alias("node")).agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("hash"),
        F.min("offset").alias("from"),
        F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("to"),
    )
    out = [settle(leaves)]
    for _ in range(levels):
        below = out[-1]
        out.append(
            settle(
                below.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(
                    F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "hash")))), 256).alias("hash"),
                    F.min("from").alias("from"),
                    F.max("to").alias("to"),
                )
            )
        )
    return out


def levels_of(*archives: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves until both archives end in at most two nodes (of negative and other numbers)."""
    largest = reduce(DataFrame.unionByName, (a.select("number") for a in archives)).agg(
        F.max(F.greatest(F.col("number"), -F.col("number") - 1))
    ).first()[0]
    levels = 0
    while largest and largest > 0:
        largest //= fanout
        levels += 1
    return levels


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Record numbers at which two archives differ: ``number, state, file, offset, length, offset_2, length_2``.

    ``state`` is ``lost`` (only the first has it), ``added`` (only the second),
    or ``changed``.  Place and length are those of all records of that number in
    either archive, NULL where there is none.  Equal archives give no rows.
    """
    levels = levels_of(first, second, fanout=fanout)
    trees = tree(first, levels, fanout), tree(second, levels, fanout)
    odd = None
    for level in range(levels, -1, -1):
        left, right = (
            t[level].select("node", *[F.col(c).alias(f"{c}_{i}") for c in ("hash", "from", "to")])
            for i, t in enumerate(trees, 1)
        )
        if odd is not None:
            above = odd.select(F.col("node").alias("above"))
            left, right = (
                side.withColumn("above", F.floor(F.col("node") / fanout)).join(above, "above", "left_semi").drop("above")
                for side in (left, right)
            )
        odd = settle(left.join(right, "node", "full").where("NOT (hash_1 <=> hash_2)"))
        if odd.isEmpty():
            break
    state = F.when(F.col("hash_2").isNull(), "lost").when(F.col("hash_1").isNull(), "added").otherwise("changed")
    return odd.select(
        F.col("node").alias("number"),
        state.alias("state"),
        F.floor(F.col("node") / SEGMENT).alias("file"),
        F.col("from_1").alias("offset"),
        (F.col("to_1") - F.col("from_1")).alias("length"),
        F.col("from_2").alias("offset_2"),
        (F.col("to_2") - F.col("from_2")).alias("length_2"),
    )
