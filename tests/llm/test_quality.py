"""Counts against plain Python, the weighing of rules against plain expectation-maximisation, and what is kept."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstone.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, m int, id int"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", 2, 3) for i, t in rows], SCHEMA)


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "δέλτα", "#tag", "<b>", "12%", "é", "𝄞", " ", "x"]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        if rng.random() < 0.5 and len(words) > 12:  # a passage again, overlapping itself or not
            at, to = sorted(rng.sample(range(len(words)), 2))
            words += words[at:to] * rng.randrange(1, 4)
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for w in words))
    return out


ODD = [None, "", " \n\n ", "one", "a\na\n\n \na", "same " * 8, "same " * 9, "a b " * 40, "\x1c\x1f", "line\n" * 50, "w1 " + "long" * 100_000, " ".join(str(k) for k in range(30_000)), " ".join(str(k % 11) for k in range(20_000))]


def test_counts(spark):
    rows = list(enumerate(ODD + texts(1, 200))) + [(3, "one"), (None, "null id")]
    got = quality.judge(table(spark, rows)).collect()
    assert got[0].asDict().keys() == {"doc_id", *BASE, "base_failed", "kept", "p_good"}
    want = []
    for i, t in rows:
        c = counts(t)
        want.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert sorted(((r.doc_id, *(r[c] for c in BASE), r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert all(0 <= r.p_good <= 1 for r in got)


@given(st.lists(st.sampled_from("ab"), min_size=0, max_size=60))
@settings(max_examples=30, deadline=None)
def test_repeats_of_two_words(spark, words):
    text = " ".join(words)
    m = spark.createDataFrame([(text,)], "t string").select(quality.measured(F.col("t")).alias("m")).first().m
    assert tuple(m[c] for c in BASE) == counts(text)


def expected(votes, rounds=30):
    """Expectation-maximisation row by row."""
    prior, p, q = 0.8, dict.fromkeys(quality.RULES, 0.005), dict.fromkeys(quality.RULES, 0.15)

    def posterior(v):
        odds = math.log(prior / (1 - prior))
        for r, x in v.items():
            odds += math.log(p[r] / q[r]) if x < 0 else math.log((1 - p[r]) / (1 - q[r])) if x > 0 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        good = [posterior(v) for v in votes]
        prior = min(max(sum(good) / len(good), 0.01), 0.99)
        for r in quality.RULES:
            a = (sum(g for g, v in zip(good, votes) if v[r] < 0) + 0.05) / (sum(g for g, v in zip(good, votes) if v[r]) + 1)
            b = (sum(1 - g for g, v in zip(good, votes) if v[r] < 0) + 0.5) / (sum(1 - g for g, v in zip(good, votes) if v[r]) + 1)
            p[r], q[r] = max(min(a, 0.999), 1e-6), max(min(max(a, b), 0.999), 1e-6)
    return prior, p, q


def test_learning(spark):
    rng, votes = random.Random(4), []
    for _ in range(400):
        good = rng.random() < 0.7
        votes.append({r: rng.choice([0, 1, 1, 1, -1] if good else [0, 1, -1, -1]) if rng.random() < 0.4 else 1 for r in quality.RULES})
    df = spark.createDataFrame([tuple(v[r] for r in quality.RULES) for v in votes], ", ".join(f"{r} int" for r in quality.RULES))
    got = quality.learn(df, tolerance=0)
    prior, p, q = expected(votes)
    assert got.prior == pytest.approx(prior, abs=1e-6)
    for r in quality.RULES:
        assert (got.bad_if_good[r], got.bad_if_bad[r]) == pytest.approx((p[r], q[r]), abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_good_documents_stay(spark, sf):
    """Held against labels, which the rules never see."""
    folder = f"/root/testdata/{sf}"
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)


def test_keep_good_is_judge(spark):
    rows = list(enumerate(ODD + texts(2, 100)))
    docs = table(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())


def test_empty(spark):
    assert quality.judge(table(spark, [])).count() == 0
    assert quality.keep_good(table(spark, [])).count() == 0
    assert [r.kept for r in quality.judge(table(spark, [(1, None)])).collect()] == [False]


def test_no_python_in_the_plan(spark):
    plan = quality.judge(table(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
