"""Fingerprints and links against brute force, and the defined results of odd rows."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.llm import simhash
from turnstone.llm.common import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, root int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3) for i, t in rows], SCHEMA)


def brute_print(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, distance=2):
    found = {f: f for f in prints}

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((top(a), top(b)))
                found[y] = x
    return {f: top(f) for f in prints}


@given(st.text(alphabet="aAbBÄé \t\n\x0b.", max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_a_very_long_text_is_counted_whole():
    text = " ".join(str(k % 977) for k in range(150_000))
    assert simhash.fingerprint(text) == brute_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket_limit", [2, 16])
def test_links_join_what_all_pairs_join(spark, bucket_limit):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for center in [rng.getrandbits(64), 1 << 63, 0]:  # clouds: chains of near prints, and many round one
        at = center
        for _ in range(30):
            at ^= 1 << rng.randrange(64)
            prints.add(at)
            prints.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        for _ in range(10):
            prints.add(center ^ sum(1 << k for k in rng.sample(range(64), 3)))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    links = simhash.near_links(df, bucket_limit=bucket_limit)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links.collect())  # at most two steps over a shared point
    got = {r.node % (1 << 64): r.root for r in components(links).collect()}
    want = classes(prints)
    mine = {}
    for p in prints:
        mine.setdefault(got.get(p, ("alone", p)), set()).add(p)
    theirs = {}
    for p, c in want.items():
        theirs.setdefault(c, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_a_ball_of_fingerprints_leaves_few_links(spark):
    """20,000 fingerprints around one point make over 600,000 links, of which no more than one each is left."""
    from turnstone.llm import common

    rng = random.Random(3)
    prints = {0}
    while len(prints) < 20_000:
        prints.add(sum(1 << k for k in rng.sample(range(63), rng.randrange(1, 4))))
    table = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    links = simhash.near_links(table)
    assert common._forest(links.coalesce(1)).count() < 6 * len(prints)
    assert {r.root for r in components(links).collect()} == {0}


@pytest.mark.parametrize("most", [3, 50, 10**6])
def test_components_in_rounds_and_in_one_task(spark, most, monkeypatch):
    from turnstone.llm import common

    monkeypatch.setattr(common, "FILE_ROWS", most)
    rng = random.Random(most)
    edges = [(rng.randrange(-50, 300), rng.randrange(-50, 300)) for _ in range(200)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for u, v in edges:
            top[u] = top[v] = min(top[u], top[v])
    found = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "u bigint, v bigint")).collect()}
    assert found == {x: r for x, r in top.items() if any(u != v and x in (u, v) for u, v in edges)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1300)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_documents(spark):
    rng = random.Random(1)
    words = [rng.choice("alpha beta gamma delta omega sigma tau".split()) + str(rng.randrange(300)) for _ in range(900)]
    near = [*words[:450], "other", *words[451:]]
    rows = [(3, " ".join(words)), (9, " ".join(near)), (1, None), (2, "  \n"), (None, " ".join(words)), (4, "one"), (4, "one"), (None, "quite alone here today"), (8, "ONE")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    prints = {t: brute_print(t) for _, t in rows}
    top = classes(set(prints.values()))
    least = {}
    for i, t in rows:
        c = top[prints[t]]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert got == {(i, f"{prints[t]:016x}", least[top[prints[t]]]) for i, t in rows}
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [(1, None), (3, " ".join(words)), (4, "one"), (None, "quite alone here today")]))


def test_rows_of_one_id_in_different_groups_both_stay(spark):
    rows = [(1, "a b c d e f"), (1, "something else that is quite different"), (2, "a b c d e f")]
    assert sorted(r.text for r in simhash.keep_one(table(spark, rows)).collect()) == sorted([rows[0][1], rows[1][1]])


def test_a_large_group_of_copies_and_an_empty_table(spark):
    rows = spark.range(3000).select((F.col("id") + 5).alias("doc_id"), F.lit("the same words in every row").alias("text"))
    got = simhash.near_duplicates(rows)
    assert got.count() == 3000 and got.select("component_id").distinct().collect() == [(5,)]
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.keep_one(table(spark, [])).count() == 0
