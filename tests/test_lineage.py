"""Chains against a walk in plain Python: forks, orphans, cycles, deep chains and rewinds."""

import random

import pytest

from turnstone.operators import inspecting, lineage

SCHEMA = "source string, record_id bigint, parent_id bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def walked(rows):
    """(root, depth, path) by (source, id); None for records that reach no root."""
    parent = {}
    for s, i, p in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)):
        parent.setdefault((s, i), p)
    out = {}
    for s, i in parent:
        path, at = [i], i
        while parent[(s, at)] is not None and (s, parent[(s, at)]) in parent and len(path) <= len(parent):
            at = parent[(s, at)]
            path.append(at)
        whole = len(path) <= len(parent)
        out[(s, i)] = (path[-1], len(path) - 1, path[::-1]) if whole else None
    return out, parent


def forest(seed, n):
    rng = random.Random(seed)
    rows = []
    for s in "ab":
        for i in range(n):
            rows.append((s, i, None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 5), i)))
        rows += [(s, 900, 901), (s, 901, 902), (s, 902, 900), (s, 903, 902), (s, 904, 903)]  # a cycle, and what hangs below it
        rows += [(s, 950, 12345), (s, 951, 950), (s, 960, 960)]  # an orphan with a child, a record that is its own parent
    return rows + [("a", 3, 2), ("a", 3, 2)]  # repeated rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lineage(spark, seed):
    rows = forest(seed, 40)
    want, parent = walked(rows)
    got = lineage.lineage(table(spark, rows)).collect()
    assert len(got) == len(want)
    for r in got:
        key = (r.source, r.record_id)
        assert ((r.root_id, r.depth, list(r.path)) if r.path is not None else None) == want[key], key
        assert r.is_cyclic == (want[key] is None)
        assert r.is_orphan == (parent[key] is not None and (r.source, parent[key]) not in parent)
        assert r.is_leaf == (not any(s == r.source and p == r.record_id for s, _, p in rows))


def test_a_deep_chain(spark):
    n = 700
    rows = [("s", k, k - 1 if k else None) for k in range(n)]
    got = {r.record_id: (r.root_id, r.depth) for r in lineage.lineage(table(spark, rows)).collect()}
    assert got == {k: (0, k) for k in range(n)}


def test_empty_and_single(spark):
    assert lineage.lineage(table(spark, [])).count() == 0
    (r,) = lineage.lineage(table(spark, [("s", 1, None)])).collect()
    assert (r.root_id, r.depth, r.path, r.is_leaf, r.is_orphan, r.is_cyclic) == (1, 0, [1], True, False, False)


def test_branches(spark):
    rows = [(s, i, p) for s, i, p in forest(3, 40) if i < 900]
    df = table(spark, rows)
    active = lineage.branch(df, lineage.active_leaf(df))
    want, _ = walked(rows)
    leaves = {s: max(i for x, i, _ in rows if x == s and not any(y == s and p == i for y, _, p in rows)) for s in "ab"}
    on = {(s, k, i) for s, leaf in leaves.items() for k, i in enumerate(want[(s, leaf)][2])}
    assert {tuple(r) for r in active.collect()} == on
    off = {(r.source, r.record_id) for r in lineage.abandoned(df.distinct(), active).collect()}
    assert off == {(s, i) for s, i, _ in rows} - {(s, i) for s, _, i in on}
    assert lineage.shared(active, active).count() == len(on)
    deepest = {r.source: r.record_id for r in lineage.common_ancestor(active, active).collect()}
    assert deepest == leaves


def test_branches_of_several_ends_and_of_cycles(spark):
    rows = forest(5, 40)
    want, _ = walked(rows)
    ends = [("a", 39), ("a", 17), ("b", 39), ("b", 903), ("a", 951), ("b", 960), ("a", 77777)]
    got = lineage.branches(table(spark, rows), spark.createDataFrame(ends, "source string, record_id bigint")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(s, e, k, i) for s, e in ends if want.get((s, e)) for k, i in enumerate(want[(s, e)][2])}


def test_the_active_leaf_by_time_or_by_id(spark):
    rows = [("s", "r1", None, 1), ("s", "r9", "r1", 2), ("s", "r10", "r1", 3), ("t", "a", None, 5), ("t", "b", "a", None), ("t", "c", "a", 6)]
    df = spark.createDataFrame(rows, "source string, record_id string, parent_id string, ts int")
    assert {r.source: r.record_id for r in lineage.active_leaf(df, ["ts"]).collect()} == {"s": "r10", "t": "c"}
    assert {r.source: r.record_id for r in lineage.active_leaf(df).collect()} == {"s": "r9", "t": "c"}
    assert {(r.source, r.position, r.record_id) for r in lineage.branch(df, lineage.active_leaf(df, ["ts"])).collect()} == {("s", 0, "r1"), ("s", 1, "r10"), ("t", 0, "a"), ("t", 1, "c")}


def test_a_very_deep_chain_without_paths(spark):
    n = 100_000
    df = spark.range(n).selectExpr("'s' AS source", "id AS record_id", "nullif(id - 1, -1) AS parent_id")
    found = lineage.lineage(df, paths=False)
    assert "path" not in found.columns
    assert found.where("root_id = 0 AND depth = record_id AND NOT is_cyclic").count() == n
    up = lineage.branch(df, spark.createDataFrame([("s", 70_000)], "source string, record_id bigint"))
    assert up.where("position = record_id").count() == 70_001 == up.count()


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("s", 1, None, "x", 5, 6), ("s", 2, 1, "y", 5, 6), ("s", 3, 9, "z", 5, 6)], "source string, record_id bigint, parent_id bigint, found string, has_parent int, _id int")
    got = {r.record_id: (r.found, r.has_parent, r.is_orphan) for r in lineage.with_parent(rows.drop("_id")).collect()}
    assert got == {1: ("x", False, False), 2: ("y", True, False), 3: ("z", False, True)}
    turns = spark.createDataFrame([(1, 0, "user", "a", "c", "l"), (1, 1, "user", "b", "d", "m")], "conv_id bigint, turn bigint, role string, text string, cut string, last string")
    cuts = spark.createDataFrame([(1, 1)], "conv_id bigint, cut bigint")
    assert [(r.turn, r.cut) for r in lineage.cut_before(turns, cuts).collect()] == [(0, "c")]
    assert sorted((r.turn, r.effect) for r in lineage.what_if(turns, cuts).collect()) == [(0, "kept"), (1, "discarded")]
    assert inspecting.unanswered(turns).count() == 2
    bodies = spark.createDataFrame([(7, '{"a":1}', "v")], "key int, body string, value string")
    assert [tuple(r) for r in inspecting.unfolded(bodies, "key", "body").collect()] == [(7, 0, "a", "1")]
    assert inspecting.by_path(bodies, "body", "$.a", "int", name="found").first().asDict() == {"key": 7, "body": '{"a":1}', "value": "v", "found": 1}


def test_parents_forks_orphans(spark):
    rows = forest(4, 30)
    df, ids = table(spark, rows), {(s, i) for s, i, _ in rows}
    for r in lineage.with_parent(df).collect():
        assert r.has_parent == (r.parent_id is not None and (r.source, r.parent_id) in ids)
        assert r.is_orphan == (r.parent_id is not None and not r.has_parent)
    assert {(r.source, r.record_id) for r in lineage.orphans(df).collect()} == {("a", 950), ("b", 950)}
    counts = {}
    for s, _, p in rows:
        if p is not None:
            counts[(s, p)] = counts.get((s, p), 0) + 1
    assert {(r.source, r.record_id): r.children for r in lineage.forks(df).collect()} == {k: n for k, n in counts.items() if n > 1}


TURNS = [(c, t, "user" if t % 2 else "assistant", f"text {c} {t}") for c in range(4) for t in range(6)]


def test_rewinds(spark):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    cuts = spark.createDataFrame([(0, 3), (1, 0), (2, 6)], "conv_id bigint, cut bigint")
    kept = {(r.conv_id, r.turn) for r in lineage.cut_before(turns, cuts).collect()}
    limit = {0: 3, 1: 0, 2: 6, 3: 99}
    assert kept == {(c, t) for c, t, _, _ in TURNS if t < limit[c]}
    effects = {(r.conv_id, r.turn): r.effect for r in lineage.what_if(turns, cuts).collect()}
    assert effects == {(c, t): "kept" if t < limit[c] else "discarded" for c, t, _, _ in TURNS}
    costs = {(r.conv_id, r.turn): (r.kept_turns, r.kept_chars) for r in lineage.cost_at(turns).collect()}
    assert costs == {(c, t): (t, sum(len(x) for d, u, _, x in TURNS if d == c and u < t)) for c, t, r, _ in TURNS if r == "user"}


def test_versions(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    old = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", "c")], schema)
    new = spark.createDataFrame([(1, 1, "user", "b"), (1, 2, "user", "C"), (1, 3, "user", "d")], schema)
    assert {(r.turn, r.change) for r in lineage.compared(old, new).collect()} == {(0, "removed"), (1, "same"), (2, "changed"), (3, "added")}
