"""Shards against the hash race written out in Python, and what moves when shards change."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from turnstone.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, part string, rank int, id int"
ROWS = [(k, f"text {k % 7} é" * (k % 5)) for k in range(400)] + [(None, "x"), (None, None), (3, None), (3, ""), (3, ""), (500, "long " * 50_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)


def digest(key, salt):
    return int(hashlib.md5(f"{key}/{salt}".encode()).hexdigest()[:12], 16)


def winner(key, weights):
    return min(range(len(weights)), key=lambda k: (-math.log((digest(key, k) + 0.5) / 2**48) / weights[k], k))


def test_against_brute_force(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    got = sharding.shard_rows(table(spark, ROWS), weights, grown_weight=3.0, parts=8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.law, r.shard, r.grown_shard) == ("key", winner(key, weights), winner(key, [*weights, 3.0]))
        assert r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_are_met(spark):
    weights = [1.0, 3.0, 2.0]
    df = spark.range(20_000).select(sharding.place(F.col("id").cast("string"), weights)["shard"].alias("s"))
    found = Counter(r.s for r in df.collect())
    assert all(abs(found[k] / 20_000 - w / 6) < 0.015 for k, w in enumerate(weights))


def test_reruns_agree_and_empty(spark):
    run = lambda: sorted(map(tuple, sharding.shard_rows(table(spark, ROWS[:300]), [1.0] * 24).collect()))
    assert run() == run()
    assert sharding.shard_rows(table(spark, []), [1.0] * 24).count() == 0


def test_rows_of_one_key_are_spread_over_the_parts(spark):
    rows = [(None, f"text {k}") for k in range(3000)]
    got = sharding.shard_rows(table(spark, rows), [1.0] * 4)
    found = got.collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(3000))
    crcs = [r.text_crc32 for r in sorted(found, key=lambda r: r.slot)]
    assert sum(a > b for a, b in zip(crcs, crcs[1:])) > 10  # many parts, each in the order of its checksums
