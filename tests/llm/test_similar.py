"""Near-duplicates by shingles against brute force over all pairs, and the pipeline's stage among them."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnstone.llm import similar
from turnstone.llm.common import components
from turnstone.plans import scratch

SCHEMA = "doc_id bigint, text string, key string, size int, s string, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    """The ids of each group of rows, by all pairs."""
    found, prints = list(range(len(rows))), [sets(t) for _, t in rows]

    def top(x):
        while found[x] != x:
            x = found[x]
        return x

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                found[top(i)] = top(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    return list(ids.values())


def least(ids):
    return min((x for x in ids if x is not None), default=None)


def made(seed):
    """Texts with near copies at all distances, chains of them, common lines and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 8)))
    common, texts = [word() for _ in range(40)], []
    for _ in range(25):
        words = [word() for _ in range(rng.choice([3, 6, 9, 30, 100, 400]))]
        texts.append(words)
        for _ in range(rng.randrange(8)):
            words = list(words if rng.random() < 0.5 else texts[-1])
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                words[rng.randrange(len(words))] = word()
            texts.append(words)
    texts += [common + [word() for _ in range(k)] for k in range(14) for _ in range(4)]
    base = [word() for _ in range(120)]
    for _ in range(60):  # a large group
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(120)] = word()
        texts.append(near)
    rng.shuffle(texts)
    odd = [(5000, None), (5001, " \n"), (None, "a b c d e f"), (None, "a b c d e f"), (5002, "A b c d e F"), (5003, "one"), (5003, "one"), (5003, "two words"), (None, "quite alone here today and now")]
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + odd


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = made(seed)
    want = sorted(((i, least(ids)) for ids in groups(rows) for i in ids), key=repr)
    assert len(groups(rows)) < len(rows) - 50
    assert sorted(map(tuple, similar.near_duplicates(table(spark, rows)).collect()), key=repr) == want


def test_no_fingerprint_decides(spark):
    """With fingerprints that tell nothing (as of similar pairs that differ in very many bits), the same sets are joined."""
    rows = made(7)
    docs = table(spark, rows)
    described = similar._described(docs, "doc_id", "text").select("key", F.xxhash64("key").alias("fp"), "size", "marks", "prefix").cache()
    once = described.groupBy("key").agg(*[F.first(c).alias(c) for c in ("fp", "size", "marks")])
    key = lambda text: int.from_bytes(similar._key(similar.shingles(text)).to_bytes(8), signed=True)
    texts = spark.createDataFrame(list({key(t): t for _, t in rows}.items()), "key bigint, text string")
    found = components(similar.links(described.select("key", "prefix"), once, lambda keys: keys.join(texts, "key")))
    top = {r.node: r.root for r in found.collect()}
    of = {}
    for ids in groups([(k, t) for k, (_, t) in enumerate(rows)]):
        keys = {key(rows[k][1]) for k in ids}
        assert len({top.get(x, x) for x in keys}) == 1
        of[min(keys)] = {top.get(x, x) for x in keys}
    assert len({x for tops in of.values() for x in tops}) == len(of)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 600)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]))
        differ = sum((x ^ y).bit_count() for x, y in zip(*([v & (2**64 - 1) for v in similar.marks(s)] for s in (a, b))))
        assert differ <= len(np.setxor1d(a, b))


def test_pages_of_a_template_are_not_paired_up(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(7))
    common = [word() for _ in range(85)]
    rows = [(k, " ".join([*common, *[word() for _ in range(15)]])) for k in range(400)]
    assert len({r.component_id for r in similar.near_duplicates(table(spark, rows)).collect()}) == 400
    described = similar._described(table(spark, rows), "doc_id", "text").select(F.posexplode("prefix").alias("at", "s"), "key", "size", *[F.get("marks", F.lit(k)).alias(f"p{k}") for k in range(4)], F.col("key").alias("root"))
    assert similar._met(described).count() == 0


def test_groups_of_one_root_do_not_meet(spark):
    rows = [(1, k, k % 3, 0, 40, 0, 0, 0, 0) for k in range(300)]
    table = spark.createDataFrame(rows, "s bigint, key bigint, root bigint, at int, size bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint")
    found = {tuple(r) for r in similar._met(table).collect()}
    assert found == {(v, u) for u in range(300) for v in range(u) if u % 3 != v % 3}


def test_the_stage_drops_near_copies_that_simhash_misses(spark):
    rows = made(3)
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert kept.columns == table(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(map(least, groups(rows)), key=repr)


def test_the_stage_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(map(least, groups(rows)))


def test_similar_sets_are_within_the_parities():
    rng = random.Random(5)
    for n in (21, 40, 100, 700):
        for _ in range(100):
            words = [str(rng.random()) for _ in range(n + 4)]
            a = similar.shingles(" ".join(words))
            b = similar.shingles(" ".join(words[: n + 4 - n // 5]))  # the least that is similar, all at one end
            assert similar.similar(a, b)
            differ = sum((x ^ y).bit_count() for x, y in zip(*([v & (2**64 - 1) for v in similar.marks(s)] for s in (a, b))))
            assert 9 * differ <= len(a) + len(b)


def test_a_common_passage_and_a_large_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    rows = [(k, " ".join([word() for _ in range(20 + k % 9)] + passage + [word() for _ in range(30)])) for k in range(300)]
    rows += [(1000 + k, " ".join([*base[: k % 80], word(), *base[k % 80 + 1 :]])) for k in range(300)]
    got = similar.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((i, least(ids)) for ids in groups(rows) for i in ids)


def test_prefixes_are_gone_when_texts_are_moved(spark, monkeypatch):
    before, verified, seen = set(scratch._written), similar._verified, []

    def run(pairs, texts):
        seen.append([x for x in scratch._written if x not in before and "prefix" in spark.read.parquet(x).columns])
        return verified(pairs, texts)

    monkeypatch.setattr(similar, "_verified", run)
    rows = made(5)[:60]
    assert similar.keep_one(table(spark, rows)).count() == len(groups(rows))
    assert seen and not any(seen)


def shuffles(spark):
    """The numbers of the shuffles whose files are on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {int(x) for x in re.findall(r"/shuffle_(\d+)_", files)}


def test_shuffle_files_go_with_their_job(spark):
    before, setting = shuffles(spark), spark.conf.get(corpus_pipeline.SHUFFLE_SETTING)
    rows = made(5)[:60]
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert spark.conf.get(corpus_pipeline.SHUFFLE_SETTING) == setting
    until = time.monotonic() + 20  # executors delete them on their own time
    while shuffles(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(map(least, groups(rows)), key=repr)


def test_pairs_that_are_joined_already_are_not_compared(spark, monkeypatch):
    rng, verified, seen = random.Random(9), similar._verified, []
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(k, " ".join([*base[: k % 120], word(), *base[k % 120 + 1 :]])) for k in range(200)]

    def run(pairs, texts):
        seen.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(similar, "_verified", run)
    assert {r.component_id for r in similar.near_duplicates(table(spark, rows)).collect()} == {0}
    assert sum(seen) <= len(rows)


def test_likeliest_and_apart(spark):
    pairs = spark.createDataFrame([(1, 2, 5), (1, 3, 7), (2, 3, 1), (4, 5, 1), (3, 4, 9)], "u bigint, v bigint, count bigint")
    assert sorted(map(tuple, similar._likeliest(pairs).collect())) == [(1, 2), (1, 3), (3, 4), (4, 5)]
    roots = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 4)], "key bigint, root bigint")
    assert sorted(map(tuple, similar._apart(pairs.select("u", "v"), roots).collect())) == [(1, 3), (2, 3), (3, 4)]


def test_empty(spark):
    assert similar.near_duplicates(table(spark, [])).count() == 0
