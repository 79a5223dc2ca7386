"""Clustering by ball trees against plain rounds over Python ints, and the defined results of odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from turnstone.llm import balltree

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, v string, cluster int"


def floored(x):
    return math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x)


def brute(rows, k, rounds, dims, kind=np.float32):
    kept = [(i, tuple(floored(float(kind(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(kind(x)) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in starts[:k]]
    if not now:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        held = [[] for _ in now]
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        now = [tuple(sum(x) // len(own) for x in zip(*own)) if own else c for c, own in zip(now, held)]
    most = 2**63 - 1
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [0] * len(now)
    for _, d, n in last:
        inertia[n] += min(d, most)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, min(d, most), min(inertia[n], most), min(sum(inertia), most), digests[n]) for i, d, n in last), key=str)


def got(spark, rows, k, rounds, dims, schema=SCHEMA, **options):
    table = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], schema)
    found = balltree.cluster(table, k=k, rounds=rounds, dims=dims, **options)
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def clustered(n, dims, seed, spread=0.1):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [c + rng.gauss(0, spread) for c in rng.choice(centers)]) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"tree_rows": 100}, {"tree_rows": 7}])
def test_against_plain_rounds(spark, options):
    rows = clustered(900, 8, 3)
    assert got(spark, rows, 12, 4, 8, **options) == brute(rows, 12, 4, 8)


def test_odd_vectors(spark):
    rows = clustered(150, 3, 5) + [(1000 + k, [1.0, 1.0, 1.0]) for k in range(400)]
    rows += [(None, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (2000, None), (2001, [1.0, None, 1.0]), (2002, [float("nan"), 0.0, 0.0]), (2003, [float("inf"), 0.0, 0.0]), (2004, [1.0, 2.0]), (2005, []), (7, rows[7][1]), (8, rows[9][1]), (-3, [-0.0, 0.0, -1e-30])]
    assert got(spark, rows, 10, 5, 3, tree_rows=64) == brute(rows, 10, 5, 3)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 5), float(k // 5 % 5)]) for k in range(100)]  # a grid, each point four times
    assert got(spark, rows, 9, 3, 2, tree_rows=16) == brute(rows, 9, 3, 2)


def test_huge_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice((1e38, -1e38, 3e20, 2.0**40, 1.5, -7.25)) * rng.random() for _ in range(3)]) for k in range(60)]
    assert got(spark, rows, 5, 3, 3, tree_rows=16) == brute(rows, 5, 3, 3)


@pytest.mark.parametrize("scale", [1e140, 1e160, 1.7e308])
def test_doubles_whose_squares_no_double_holds(spark, scale):
    rng = random.Random(8)
    rows = [(k, [rng.choice((scale, -scale, 3e20, 1.5, -7.25)) * rng.random() for _ in range(3)]) for k in range(60)] + [(100 + k, [1.0, 2.0, k / 4]) for k in range(20)]
    doubles = SCHEMA.replace("array<float>", "array<double>")
    for tree_rows in (16, 8192):
        assert got(spark, rows, 6, 3, 3, doubles, tree_rows=tree_rows) == brute(rows, 6, 3, 3, float)


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    assert got(spark, rows, 40, 5, 2) == brute(rows, 40, 5, 2)
    assert got(spark, [], 40, 5, 2) == []
    assert got(spark, [(None, [1.0, 2.0])], 40, 5, 2) == []
    assert got(spark, [(1, [1.0])], 40, 5, 2) == []


def test_balls_are_given_away_whole():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 500, (8, 6))
    points = np.concatenate([rng.normal(c, 3, (500, 6)) for c in centers])
    tree = balltree.BallTree(np.floor(points).astype(np.int64), list(range(len(points))))
    parts = list(tree.assigned(np.floor(centers).astype(np.int64)))
    size = lambda some: sum(tree.end[n] - tree.begin[n] for n, _ in some)
    assert size(parts) == len(points)
    assert size([x for x in parts if isinstance(x[1], int)]) > 0.8 * len(points)


@pytest.mark.parametrize("value", [0, 1, -1, 2**32 - 1, 2**32, -(2**32), -(2**40) - 5, 10**40, -(10**40)])
def test_limbs(value):
    assert sum(x << (32 * k) for k, x in enumerate(balltree.limbs(value))) == value
    assert all(-(2**32) < x < 2**32 for x in balltree.limbs(value))
