"""Top-k search against a scan of all pairs, and the defined results of odd vectors."""

import math
import random

import numpy as np
import pytest

from turnstone.llm import kdtree

SCHEMA = "vec_id bigint, embedding array<float>, label int, shard int, block string, v int, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    """Each row with a query's id asks; all other rows are candidates; scores saturate."""
    whole, most = [], 2**63 - 1
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in map(float, map(np.float32, v))]))
    out = []
    for n, (q, v) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for m, (i, w) in enumerate(whole) if m != n and len(w) == len(v))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(map(tuple, kdtree.top_k(table(spark, rows), every=50, k=5, **options).collect()))


def clustered(n, dims, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(k, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 150}, {"shard_rows": 20}])
def test_against_all_pairs(spark, options):
    rows = clustered(700, 8, 3)
    assert got(spark, rows, **options) == brute(rows, 50, 5)


def test_odd_vectors_ties_and_repeats(spark):
    rows = clustered(120, 4, 4)
    rows += [(1000 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(300)]  # copies: ties go to the smaller id
    rows += [(50, [0.5, 0.5, 0.5, 0.5]), (None, [9.0] * 4), (2000, None), (2050, [1.0, None, 1.0, 1.0]), (2100, [float("nan")] * 4), (2150, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3050, []), (-50, [-1.0, 0.0, 0.0, 1.0]), (7, rows[7][1])]
    assert got(spark, rows) == brute(rows, 50, 5)
    assert got(spark, rows, shard_rows=64) == brute(rows, 50, 5)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (100, [-1.0, 0.0])]
    assert got(spark, rows) == brute(rows, 50, 5)
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + k * 128), -(2.0**21)]) for k in range(0, 120, 10)]
    assert got(spark, rows) == brute(rows, 50, 5)


def test_components_whose_products_leave_the_range_of_a_long(spark):
    rows = clustered(120, 3, 5) + [(200, [3e38, 1.0, 0.0]), (201, [-3e38, 0.0, 2.0]), (250, [2.0**40, -(2.0**40), 1.0]), (7, [2.0**44, 2.0**44, 2.0**44]), (300, [3e38, 3e38, -3e38])]
    assert got(spark, rows) == brute(rows, 50, 5)
    doubles = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e308, 5.0]), (3, [0.5, 0.5]), (50, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in kdtree.top_k(doubles, every=50, k=5).orderBy("query_id", "rank").collect()]
    most = 2**63 - 1
    assert found == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 50, 65536), (0, 4, 2, -most), (50, 1, 2, 5 * 65536), (50, 2, 1, 2 * 65536), (50, 3, 0, 65536), (50, 4, 3, 32768)]


def test_signs_of_zero_and_many_copies_of_a_query(spark):
    rows = [(k, [0.0, 1.0] if k % 2 else [-0.0, 1.0]) for k in range(0, 400)] + [(k, [0.5, 0.5]) for k in range(400, 450)]
    assert got(spark, rows) == brute(rows, 50, 5)


def test_boxes_are_tight_and_bounds_hold():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-300, 300, (2000, 6)).astype(float)
    tree = kdtree.KDTree(vectors, np.arange(2000), leaf=32)
    queries = rng.integers(-300, 300, (20, 6)).astype(float)
    bounds = tree.bounds(queries)
    for node, (begin, end) in enumerate(zip(tree.begin, tree.end)):
        own = tree.vectors[begin:end]
        assert (own.min(axis=0) == tree.low[node]).all() and (own.max(axis=0) == tree.high[node]).all()
        assert (queries @ own.T <= bounds[:, [node]] + 1e-9).all()


def test_a_propagated_bound_prunes():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (4000, 3)).astype(float)
    tree = kdtree.KDTree(vectors, np.arange(4000), leaf=32)
    query = np.array([200.0, -100.0, 50.0])
    bound = tree.bounds(query[None])[0]
    best, kth = tree.search(query, bound, 5, -np.inf)
    assert sorted((b[:2] for b in best), reverse=True) == sorted(((int(s), -int(i)) for i, s in zip(range(4000), vectors @ query)), reverse=True)[:5]
    assert kth == min(best)[0] and tree.search(query, bound, 5, max(best)[0] + 1)[0] == []


def test_shards_out_of_reach_are_not_searched(spark, monkeypatch):
    rows = [(k, [10.0 * math.cos(k % 36 * math.pi / 18) + 0.01 * (k % 7), 10.0 * math.sin(k % 36 * math.pi / 18)]) for k in range(3600)]
    sent = []
    plain = kdtree._reached
    monkeypatch.setattr(kdtree, "_reached", lambda boxes, queries, scale: sent.append((boxes.count(), queries.count(), plain(boxes, queries, scale).count())) or plain(boxes, queries, scale))
    assert got(spark, rows, shard_rows=30) == brute(rows, 50, 5)
    boxes, queries, reached = sent[0]
    assert boxes > 8 and reached < boxes * queries / 2


def test_many_dimensions(spark):
    rows = clustered(150, 768, 9)
    assert got(spark, rows) == brute(rows, 50, 5)
    assert got(spark, rows, shard_rows=40) == brute(rows, 50, 5)


def test_blocks_of_queries_meet_shards(spark, monkeypatch):
    """Several blocks of a home shard, and a row for a block and a shard rather than for a query and a shard."""
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 3)
    seen, plain = [], kdtree._reached
    monkeypatch.setattr(kdtree, "_reached", lambda *args: seen.append(plain(*args)) or seen[-1])
    rows = [(50 * k, v) for k, v in clustered(60, 4, 2)]
    assert got(spark, rows, shard_rows=20) == brute(rows, 50, 5)
    pairs = [(r.home, r.block, r.shard) for r in seen[0].collect()]
    assert len(set(pairs)) == len(pairs) and all(h != x for h, _, x in pairs)
