"""Searches and web tables, against brute force on small tables."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from seriata.llm import fixity, neighbours, queries, topk, urls
from seriata.llm.common import table

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    ok, text = compare(spark, duck(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name])
    assert ok, text


@pytest.fixture
def odd_vectors(spark):
    """Invalid vectors, copies, ties, repeated rows and a vector of another length."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(0, rows[0][1]), (5, rows[5][1])]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(204, [0.0] * 4), (205, []), (206, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).withColumn("ids", F.lit(1)).withColumn("score", F.lit("x"))


def _usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is None or not v or len(v) != 4 or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out[i] = np.array(v, float)
    return out


def _plain(vectors, asked, k, product):
    out = set()
    for q in asked:
        if q in vectors:
            scored = sorted(((-product(vectors[q], v), i) for i, v in vectors.items() if i != q))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def test_neighbours_of_all_leaves_are_exact(spark, odd_vectors):
    vectors = _usable([(r.vec_id, r.embedding) for r in odd_vectors.collect()], zero=False)
    asked = [0, 5, 20, 100, 204, 206]
    found = neighbours.search(odd_vectors, odd_vectors.where(F.col("vec_id").isin(asked)), 7, trees=3, visit=3.0)
    want = _plain(vectors, asked, 7, lambda a, b: float((a * b).sum()))
    got = {tuple(r) for r in found.collect()}
    assert {g[:3] for g in got} == {w[:3] for w in want}
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(sorted(got), sorted(want)))
    empty = odd_vectors.limit(0)
    assert neighbours.search(empty, empty, 7).isEmpty()
    assert neighbours.search(odd_vectors, empty, 7).isEmpty()


def test_rounds_of_the_neighbour_search_change_no_result(spark, odd_vectors):
    assert [neighbours._round(n, 2, 8) for n in (0, 1, 2, 15, 16, 127, 128)] == [0, 0, 1, 1, 2, 2, 3]
    asked = odd_vectors.where(F.col("vec_id").isin(0, 5, 20, 204))
    one, many = (neighbours.search(odd_vectors, asked, 7, trees=3, visit=3.0, first=f, more=2).collect() for f in (3, 1))
    assert len(one) and sorted(one) == sorted(many)


def test_neighbours_reach_the_recall(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    found = queries.QUERIES["op2_neighbours"](spark, "/root/testdata/sf0.01").collect()
    vectors = _usable_wide(rows.collect())
    want = _plain(vectors, [i for i in vectors if i % 20 == 0], 20, lambda a, b: float((a * b).sum()))
    pairs = {(q, i) for q, _, i, _ in want}
    assert len(found) == len(pairs)
    assert len({(r.query_id, r.vec_id) for r in found} & pairs) >= 0.9 * len(pairs)


def _usable_wide(rows):
    return {r.vec_id: np.array(r.embedding, float) for r in rows}


def test_the_queue_takes_the_best_branch_of_any_tree():
    rng = np.random.default_rng(1)
    points = neighbours.points_of(rng.normal(size=(200, 5)), 5.0)
    forest = neighbours.Forest(tuple(neighbours.grow(points, 20, rng) for _ in range(3)), 5.0)
    for tree in forest.trees:
        assert np.allclose(np.bincount(tree.leaves(points), minlength=len(tree.sizes)) / 200, tree.sizes, atol=0.011)
    order = neighbours.leaves_to_visit(forest, rng.normal(size=5), 10.0)
    assert len(order) == len(set(order)) == sum(len(t.sizes) for t in forest.trees)


def test_the_queue_for_many_queries_gives_the_order_of_a_heap():
    rng = np.random.default_rng(4)
    points = neighbours.points_of(rng.normal(size=(700, 6)), 7.0)
    forest = neighbours.Forest((*(neighbours.grow(points, 9, rng) for _ in range(4)), neighbours.grow(points[:5], 9, rng)), 7.0)
    asked = rng.normal(size=(30, 6))
    many = neighbours.Queue(forest)
    for visit in (0.02, 0.4, 1.75, 9.0):
        for query, leaves in zip(asked, many.reached(asked, visit)):
            want = _heap(forest, query, visit)
            assert neighbours.leaves_to_visit(forest, query, visit) == want
            assert leaves.tolist() == [many.first_leaf[tree] + leaf for tree, leaf in want]


def _heap(forest, query, visit):
    point = np.append(query / np.linalg.norm(query), 0.0)
    margins = [(t.normals @ point - t.offsets).tolist() for t in forest.trees]
    queue = [(-np.inf, i, 0 if len(t.offsets) else -1) for i, t in enumerate(forest.trees)]
    heapq.heapify(queue)
    found, rows = [], 0.0
    while queue and rows < visit:
        worst, tree, node = heapq.heappop(queue)
        if node < 0:
            found.append((tree, -1 - node))
            rows += forest.trees[tree].sizes[-1 - node]
        else:
            margin, (left, right) = margins[tree][node], forest.trees[tree].children[node].tolist()
            heapq.heappush(queue, (max(worst, margin), tree, left))
            heapq.heappush(queue, (max(worst, -margin), tree, right))
    return found


def test_vectors_and_queries_are_written_once_however_many_leaves_they_meet(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1200)], "vec_id long, embedding array<float>")
    written, settle = [], neighbours.settle
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "settle", lambda df, *by: written.append(settle(df, *by)) or written[-1])
    neighbours.search(rows, rows.where("vec_id % 4 = 0"), 5).count()
    assert sum(df.count() for df in written if "vec" in df.columns) <= 2 * 1200
    assert sum(df.count() for df in written if "query" in df.columns) == 300


def test_groups_rounds_and_looking_up_leaves_change_no_result(spark, odd_vectors, monkeypatch):
    rng = np.random.default_rng(7)
    rows = odd_vectors.select("vec_id", "embedding").unionByName(
        spark.createDataFrame([(1000 + i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    )
    asked = rows.where("vec_id IN (0, 5, 100, 204) OR vec_id % 11 = 0")
    found = lambda visit: sorted(map(tuple, neighbours.search(rows, asked, 7, trees=3, visit=visit, sample=256).collect()))
    one = found(0.3)
    assert {r[0] for r in one} == {0, 5, 100, *(i for i in range(1300) if i % 11 == 0 and (i < 40 or 100 <= i < 130 or i >= 1000))}
    for name, value in (("BLOCK", 16), ("GROUP", 2000), ("TILE", 32), ("PART", 8)):
        monkeypatch.setattr(neighbours, name, value)
    assert found(0.3) == one
    monkeypatch.setattr(neighbours, "FEW", 9.0)
    assert found(0.3) == one
    vectors = _usable([(r.vec_id, r.embedding) for r in rows.collect()], zero=False)
    want = _plain(vectors, sorted({r[0] for r in one}), 7, lambda a, b: float((a * b).sum()))
    assert {r[:3] for r in found(3.0)} == {w[:3] for w in want}


def test_a_number_with_several_vectors_counts_once_with_its_best(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(70, [9.0 + i / 100, 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(df, spark.createDataFrame([(500, [1.0, 0.0, 0.0])], df.schema), 5, trees=2, visit=2.0).orderBy("rank").collect()
    best = sorted(((-np.float32(v[0]), i) for i, v in rows if i < 70), key=lambda x: (x[0], x[1]))[:4]
    assert [r.vec_id for r in found] == [70, *(i for _, i in best)] and abs(found[0].score - 9.39) < 1e-6


@pytest.mark.parametrize("bucket", [2048, 8])
def test_topk_is_exact(spark, odd_vectors, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    vectors = {i: [math.floor(1024 * x) for x in v] for i, v in _usable(rows, zero=True).items()}
    asked = [0, 5, 20, 100, 204, 206]
    found = topk.search(odd_vectors, odd_vectors.where(F.col("vec_id").isin(asked)), 7)
    assert {tuple(r) for r in found.collect()} == _plain(vectors, asked, 7, lambda a, b: sum(x * y for x, y in zip(a, b)))
    empty = odd_vectors.limit(0)
    assert topk.search(empty, empty, 7).isEmpty() and topk.search(odd_vectors, empty, 7).isEmpty()


def test_repeated_rows_take_no_place_of_other_numbers(spark, odd_vectors):
    often = odd_vectors.where("vec_id BETWEEN 100 AND 129").crossJoin(spark.range(3).select())
    hot = odd_vectors.where("vec_id = 100").crossJoin(spark.range(25).select())
    rows = odd_vectors.unionByName(often).unionByName(hot)
    asked = odd_vectors.where("vec_id IN (100, 101, 115)")
    for search in (lambda of: topk.search(of, asked, 7), lambda of: neighbours.search(of, asked, 7, trees=3, visit=3.0)):
        got, want = ({(r.query_id, r["rank"], r.vec_id) for r in search(of).collect()} for of in (rows, odd_vectors))
        assert got == want and len(got) == 21


def test_products_beyond_doubles_are_exact():
    a = np.array([3_000_000_019, -7], np.int64)
    b = np.array([[3_000_000_021, 5], [1 << 62, 1]], np.int64)
    assert topk.products(a, b).tolist() == [3_000_000_019 * 3_000_000_021 - 35, (1 << 63) - 1]


def test_component_ranges_lose_no_candidate():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(500, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for q in units[:20]:
        for cosine in (0.6, 0.9):
            assert set(np.flatnonzero(units @ q >= cosine)) <= set(topk.candidates(q, cosine, units))


# ---------------------------------------------------------------- URLs


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("b.org", "", "block"), (None, "/", "block")]
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    cases = {
        "http://Example.NET/en/a?q#f": ("example.net", "/en/a", "example.net/en/", "allow"),
        "http://example.net/e": ("example.net", "/e", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "http://sub.a.org/xyz": ("sub.a.org", "/xyz", "a.org/x", "block"),
        "https://b.org?x": ("b.org", "", "b.org", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://É.net/ü#": ("É.net", "/ü", "net/", "block"),
        "x://" + "a." * 3000 + "net/" + "b/" * 3000: ("a." * 3000 + "net", "/" + "b/" * 3000, "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2 + [(None, None)], "page_id long, url string")
    pages = pages.withColumn("rule", F.lit(1)).withColumn("suffix", F.lit("s"))
    got = urls.judge(pages, rules)
    assert got.count() == 2 * len(cases) + 1
    for r in got.collect():
        want = cases[r.url] if r.url is not None else ("", "", None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == want
    assert urls.judge(pages.limit(0), rules).isEmpty()
    assert urls.judge(pages, rules.limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").isEmpty()


def test_the_filter_is_native(spark):
    plan = queries.QUERIES["op8_url_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- fixity

PAGES = "page_id long, url string, html string"


def test_only_differing_records_are_reported(spark):
    rows = [(i, f"u{i}", "x" * (i % 7)) for i in range(3000)] + [(None, None, None), (5, "u5", "again"), (9, "u9", "xx"), (-3, "u", "")]
    first = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit(0)).withColumn("digest", F.lit(""))
    assert fixity.audit(fixity.archive(first), fixity.archive(first.repartition(3))).isEmpty()
    other = [(i, u, h + "!" if i == 2047 else h) for i, u, h in rows if i != 1024] + [(4000, "new", ""), (7, "u7", "")]
    second = spark.createDataFrame(other, PAGES)
    got = {r.number: r for r in fixity.audit(fixity.archive(first), fixity.archive(second)).collect()}
    assert {i: r.state for i, r in got.items()} == {1024: "lost", 2047: "changed", 4000: "added", 7: "changed"}
    assert got[2047].length_2 == got[2047].length + 1 and got[1024].offset == 0 and got[1024].file == 1
    none = spark.createDataFrame([], PAGES)
    assert fixity.audit(fixity.archive(none), fixity.archive(none)).isEmpty()
    lost = fixity.audit(fixity.archive(first), fixity.archive(none))
    assert lost.count() == len({r[0] for r in rows}) and lost.where("state <> 'lost'").isEmpty()
