"""Forests, common ancestors and cycles against walks in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import forest

SCHEMA = "source string, record_id bigint, parent_id bigint, pre int, weight int"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for s in "ab":
        for i in range(n):
            rows.append((s, i, None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 6), i)))
        rows += [(s, 900, 901), (s, 901, 902), (s, 902, 900), (s, 903, 902), (s, 904, 903), (s, 910, 911), (s, 911, 910)]  # cycles, and what hangs below one
        rows += [(s, 950, 12345), (s, 951, 950), (s, 960, 960)]  # an orphan with a child, a record that is its own parent
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, (r[1] * 13) % 17) for r in rows], SCHEMA)


def tree(rows):
    parent = {(s, i): p for s, i, p in rows}
    up = {(s, i): (s, p) if (s, p) in parent else None for (s, i), p in parent.items()}

    def way(x):
        out = []
        while x is not None and x not in out:
            out.append(x)
            x = up[x]
        return out if x is None else None

    return {x: way(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numbers(spark, seed):
    rows = made(seed, 60)
    ways = tree(rows)
    found = {(r.source, r.record_id): r for r in forest.numbered(table(spark, rows), F.col("weight")).collect()}
    assert set(found) == {x for x, way in ways.items() if way}
    for s in "ab":
        assert sorted(r.pre for x, r in found.items() if x[0] == s) == list(range(sum(x[0] == s for x in found)))
    for x, r in found.items():
        below = {y for y, way in ways.items() if way and x in way}
        assert below == {y for y, q in found.items() if y[0] == x[0] and r.pre <= q.pre < r.pre + r.size}
        assert r.size == len(below) and r.depth == len(ways[x]) - 1 and r.total == sum((i * 13) % 17 for _, i in below)
        assert r.parent_id == (ways[x][1][1] if r.depth else None)
        children = sorted(i for (t, i), way in ways.items() if way and len(way) > 1 and way[1] == x)
        assert children == sorted(children, key=lambda i: found[(x[0], i)].pre)
    gone = {(r.source, r.record_id): (r.n, r.total) for r in forest.taken_away(table(spark, rows), F.col("weight")).collect()}
    assert gone == {x: (r.size, r.total) for x, r in found.items()}


def test_common_ancestors(spark):
    rows = made(4, 70)
    ways = tree(rows)
    rng = random.Random(5)
    asked = [(s, rng.randrange(70), rng.randrange(70)) for s in "ab" for _ in range(150)]
    asked += [("a", 3, 3), ("a", 900, 1), ("a", 77, 1), ("a", 950, 951), ("a", 951, 950), ("a", 951, 4), ("c", 1, 2), ("a", 3, 3)]
    pairs = spark.createDataFrame([(*p, "x") for p in asked], "source string, a bigint, b bigint, ancestor_of string")
    want = []
    for s, a, b in asked:
        mine, other = ways.get((s, a)) or [], ways.get((s, b)) or []
        want.append((s, a, b, next((x[1] for x in mine if x in other), None)))
    found = [(r.source, r.a, r.b, r.ancestor) for r in forest.common_ancestors(table(spark, rows), pairs).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_a_deep_chain_and_a_wide_star(spark):
    n = 400
    rows = [("deep", k, k - 1 if k else None) for k in range(n)] + [("wide", k, 0 if k else None) for k in range(n)]
    found = {(r.source, r.record_id): (r.pre, r.size, r.depth) for r in forest.numbered(table(spark, rows)).collect()}
    assert all(found[("deep", k)] == (k, n - k, k) for k in range(n))
    assert all(found[("wide", k)] == (k, 1, 1) for k in range(1, n)) and found[("wide", 0)] == (0, n, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for s in ("a", "b"):
        ids = rng.sample(range(1000), 120)
        for n in (1, 2, 3, 7, 40):
            ring, ids = ids[:n], ids[n:]
            rows += [(s, x, y) for x, y in zip(ring, ring[1:] + ring[:1])]
            at = ring.index(min(ring))
            want |= {(s, min(ring), n, k, x) for k, x in enumerate(ring[at:] + ring[:at])}
        known = [i for _, i, _ in rows]
        for i in ids[:60]:  # long tails below the cycles
            rows.append((s, i, known[-1] if rng.random() < 0.7 else rng.choice(known)))
            known.append(i)
    rows += [("t", k, k - 1 if k else None) for k in range(9)]
    assert sorted(map(tuple, forest.cycles(table(spark, rows)).collect())) == sorted(want)


def test_nothing(spark):
    none, trees = table(spark, []), table(spark, [("a", 1, None), ("a", 2, 1), ("a", 2, 1)])
    pairs = spark.createDataFrame([("a", 1, 2)], "source string, a bigint, b bigint")
    assert forest.numbered(none).count() == forest.cycles(none).count() == forest.cycles(trees).count() == 0
    assert [r.ancestor for r in forest.common_ancestors(none, pairs).collect()] == [None]
    assert [r.ancestor for r in forest.common_ancestors(trees, pairs).collect()] == [1]
    assert forest.common_ancestors(trees, pairs.where("false")).count() == 0
    assert sorted((r.record_id, r.size) for r in forest.numbered(trees).collect()) == [(1, 2), (2, 1)]
