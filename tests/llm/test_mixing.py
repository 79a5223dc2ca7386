"""Targets, draws and permutations against their definitions, and what a mix takes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnstone.llm import common, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, start string, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2) for i, t, s in rows], SCHEMA)


def poured(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * level > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = weights[k] * level
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 7)  # prefix sums over many ranges
    rng = random.Random(seed)
    sizes = {f"s{k:02}" if k else None: rng.choice((0, 1, 5, rng.randrange(10_000))) for k in range(rng.randrange(1, 40))}
    table = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], "source string, size bigint, docs bigint")
    got = {r.name: r for r in mixing.planned(table, 64).collect()}
    names = sorted(x for x in sizes if x is not None) + [None]
    want = poured([sizes[x] for x in names], [1.0 + k % 3 for k in range(len(names))], 3.0)
    assert [got[x].rank for x in names] == list(range(len(names))) and len(got) == len(names)
    assert [got[x].target for x in names] == pytest.approx(want, abs=1e-6)
    for r in got.values():
        assert r.base * r.blocks + r.extra == r.source_size and r.base + (r.extra > 0) <= 64 and r.slots <= 3 * r.blocks
    empty = mixing.planned(table.where("false"), 64)
    assert empty.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutations(n):
    for key in (0, 12345, -9):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))


def test_draws_sum_up():
    counts = mixing.draw([100, 0, 7, 5000], 16, 3)
    assert counts.sum(axis=0).tolist() == [100, 0, 7, 5000]
    assert np.ptp(counts.sum(axis=1)) <= 1


def rows():
    found = [(k, " ".join(f"w{k}-{j}" for j in range(k % 90)), f"s{k % 4}") for k in range(300)]
    found += [(k, " ".join(f"n{k}-{j}" for j in range(40)), None) for k in range(300, 320)]
    found += [(400, "tiny source", "a"), (401, None, "a"), (402, "", "z"), (None, "null id here", "s1"), (7, "same row", "s2"), (7, "same row", "s2")]
    return found + [(500, " ".join(f"big{j}" for j in range(30_000)), "s3")]


def test_words_taken(spark):
    got = mixing.words_taken(table(spark, rows())).collect()
    assert sorted(repr((r.doc_id, r.size)) for r in got) == sorted(repr((i, len((t or "").split()))) for i, t, _ in rows())
    sizes = Counter()
    for _, t, s in rows():
        sizes[s] += len((t or "").split())
    names = sorted(x for x in sizes if x is not None) + [None]
    want = dict(zip(names, poured([sizes[x] for x in names], [1.0 + k % 3 for k in range(len(names))], 3.0)))
    by_id = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_id[(r.source_size, round(r.target, 6))].append(r.taken)
    for x in names:
        if want[x]:
            assert abs(sum(by_id[(sizes[x], round(want[x], 6))]) - want[x]) <= 128
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.words_taken(table(spark, rows())).collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    docs = table(spark, rows())
    taken = Counter()
    for r in mixing.words_taken(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    texts, found = defaultdict(list), Counter()
    for i, t, _ in rows():
        texts[i].append(t or "")
    for r in mixed.collect():
        found[r.doc_id] += len(r.text.split())
        assert any(r.text in t for t in texts[r.doc_id]) and r.n_chars == len(r.text) and r.row == 2
    assert +found == +taken


def test_small_sources_come_near_their_targets(spark):
    docs = [(1, " ".join(["x"] * 50), "a"), (2, " ".join(["y"] * 60), "b"), (3, " ".join(["z"] * 70), "c"), (4, "one", "d"), (5, "two words", "e")]
    got = {r.doc_id: r for r in mixing.words_taken(table(spark, docs)).collect()}
    assert all(abs(r.taken - r.target) <= 1 for r in got.values()), got
    mixed = Counter()
    for r in mixing.mixed_documents(table(spark, docs)).collect():
        mixed[r.doc_id] += len(r.text.split())
    assert mixed == Counter({i: r.taken for i, r in got.items()})


def test_more_sources_than_one_group_deals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(common, "RANGE_ROWS", 20)
    docs = [(k, " ".join(f"w{j}" for j in range(20 + k % 50)), f"s{k % 90}") for k in range(360)]
    got = mixing.words_taken(table(spark, docs)).collect()
    by_source = defaultdict(int)
    for r in got:
        by_source[docs[r.doc_id][2]] += r.taken
        assert r.taken <= 3 * r.size
    targets = {docs[r.doc_id][2]: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(len(t.split()) for _, t, _ in docs))
    assert all(abs(by_source[s] - t) <= 4 for s, t in targets.items())


def test_a_very_long_text_and_a_hot_source(spark):
    docs = [(1, " ".join(f"w{j}" for j in range(300_000)), "a"), *[(k, "a few words here", "hot") for k in range(2, 3000)], (3000, "x y", "c")]
    taken = Counter({r.doc_id: r.taken for r in mixing.words_taken(table(spark, docs), block=512).collect()})
    found = Counter()
    for r in mixing.mixed_documents(table(spark, docs), block=512).select("doc_id", "text").collect():
        found[r.doc_id] += len(r.text.split())
    assert found == +taken


def test_empty(spark):
    assert mixing.words_taken(table(spark, [])).count() == 0
    assert mixing.mixed_documents(table(spark, [])).count() == 0
    assert [r.taken for r in mixing.words_taken(table(spark, [(1, None, None)])).collect()] == [0]
