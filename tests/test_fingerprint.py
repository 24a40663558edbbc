"""Equality of relations by sums of hashes."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from seriata.operators import fingerprint, reconcile

SCHEMA = "k string, n int, v double"


def _rows(n=4000):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", "", None]), rng.randint(0, 50), rng.choice([0.5, 1.5, None, float("nan")])) for _ in range(n)]
    return rows + [("hot", 1, 1.0)] * 2000


def _plain(left, right):
    a, b = (collections.Counter(map(repr, rows)) for rows in (left, right))
    return sorted((r, a[r], b[r]) for r in a.keys() | b.keys() if a[r] != b[r])


def _found(df):
    return sorted((repr(tuple(r)[:3]), r.izquierda, r.derecha) for r in df.collect())


@pytest.mark.parametrize("ranges", [2, 1024])
def test_differences_are_those_of_counters(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprint, "RANGES", ranges)
    left = _rows()
    right = left[50:-3] + [left[7]] * 3 + [("new", None, 2.0), (None, None, None)]
    one = spark.createDataFrame(left, SCHEMA).repartition(5)
    other = spark.createDataFrame(right, SCHEMA).repartition(3).select("v", "k", "n")
    assert _found(fingerprint.multiset_difference(one, other)) == _plain(left, right)
    assert not fingerprint.multisets_equal(one, other)
    shuffled = spark.createDataFrame(random.Random(1).sample(left, len(left)), SCHEMA)
    assert fingerprint.multisets_equal(one, shuffled) and fingerprint.multiset_difference(one, shuffled).isEmpty()


def test_all_rows_differ_and_empty_relations(spark):
    one = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.lit(0.0).alias("v"))
    none = one.limit(0)
    assert fingerprint.multiset_difference(one, none).count() == 5000
    assert fingerprint.multisets_equal(none, none) and not fingerprint.multisets_equal(none, one)
    assert fingerprint.multisets_equal(one, one.withColumn("v", F.lit(-0.0)))
    assert not fingerprint.multisets_equal(one, one.withColumn("k", F.when(F.col("k") != "7", F.col("k"))))


def test_columns_and_types_must_be_the_same(spark):
    one = spark.range(3)
    for other in (one.withColumn("id", F.col("id").cast("int")), one.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError):
            fingerprint.multisets_equal(one, other)


def test_no_row_is_shuffled_to_prove_equality(spark):
    one = spark.range(10000).select(F.col("id").cast("string").alias("text"), "id")
    columns = one.columns
    df = fingerprint.differing_ranges(fingerprint.marked(one, columns), fingerprint.marked(one, columns))
    text = df._jdf.queryExecution().executedPlan().toString()
    for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert re.match(r"(r0|_groupingexpression)#\d+, ", exchange), text
    assert "partial_sum" in text and "Join" not in text


def test_results_are_compared_whatever_their_types(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 0.1)], "a int, b double")
    other = spark.createDataFrame([(0.1 + 1e-9, 2), (2.0, 1)], "b double, A bigint")
    assert reconcile.results_equal(one, other) and not reconcile.results_equal(one, other.union(other))
