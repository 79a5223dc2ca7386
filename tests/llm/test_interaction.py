"""The filter audit against a replay in Python, and the defined results of odd rows."""

import itertools
import random
import re
from collections import Counter

import pytest

from turnstone.llm import interaction

DOCS = "doc_id bigint, text string, source string, fails int, part string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int, source string, n bigint"


def brute(docs, labels):
    """Each document through each order of the filters."""
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t) == 1} for x in (lambda q, t: q, lambda q, t: t))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    counts, parts = Counter(), set()
    for i, text, part in docs:
        text, part = text or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and text in least and i > least[text],
        }
        parts.add(part)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order):
                key = part, "".join(order), step + 1
                here = fails[f] and not gone
                counts[key, "redundant"] += fails[f] and gone
                gone |= fails[f]
                counts[key, "kept"] += not gone
                counts[key, "removed"] += here
                counts[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                counts[key, "good_lost"] += here and i in good
                counts[key, "toxic_lost"] += here and i in toxic
                counts[(part, f), "shapley"] += here
    names = interaction.COUNTS
    return sorted((p, "".join(o), k + 1, *[counts[(p, "".join(o), k + 1), c] for c in names], counts[(p, o[k]), "shapley"]) for p in parts for o in itertools.permutations("ABCDE") for k in range(5))


def got(spark, docs, labels):
    table = spark.createDataFrame([(*d, 9, "x", 7) for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, "y", 8) for x in labels], LABELS)
    found = interaction.audit(interaction.flagged(table, marks))
    return sorted(map(tuple, found.select("part", "filter_order", "step", *interaction.COUNTS, "shapley").collect()))


def made(rng, n):
    def text():
        words = [rng.choice("abcdefgh") * rng.randrange(1, 40) for _ in range(rng.choice((5, 150, 250)))]
        out = rng.choice((" ", "\n", "\t ")).join(words)
        return (out.upper() if rng.random() < 0.2 else out) + rng.choice(("", "", "#", " é|", "\x1f "))

    some = [text() for _ in range(n // 2)]
    return [(k, rng.choice(some) if rng.random() < 0.5 else text(), rng.choice(("web", "web", "web", "books", "", None))) for k in range(n)]


def test_against_a_replay(spark):
    docs = made(random.Random(1), 120)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 120, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    found = got(spark, docs, labels)
    assert found == brute(docs, labels)
    assert len(found) == 600 * 3


def test_odd_rows(spark):
    long = "word " * 300_000 + "#"
    docs = [(1, None, None), (2, "", ""), (3, "", "web"), (3, "", "web"), (4, long, "web"), (5, long, "web"), (5, long, "web"), (None, long, "web"), (None, None, None), (6, "A" * 9, "o"), (-1, "A" * 9, "o")]
    labels = [(2, None, None), (3, 1, 1), (3, 0, 0), (5, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)
    assert got(spark, [], labels) == []
    assert got(spark, docs, []) == brute(docs, [])


def test_properties(spark):
    """Whatever the order, the same documents are left, and the filters' shares of what goes add up."""
    docs = made(random.Random(2), 80)
    left, shares = {}, Counter()
    for part, order, step, kept, removed, *_, shapley in got(spark, docs, []):
        if step == 5:
            assert left.setdefault(part, kept) == kept
        if order == "ABCDE":
            shares[part] += shapley
    for part, kept in left.items():
        assert shares[part] == 120 * (sum((p or "") == part for _, _, p in docs) - kept)


def test_other_filters(spark):
    flags = spark.createDataFrame([("p", f, False, False) for f in (0, 1, 2, 3, 3)], "part string, fails int, good boolean, toxic boolean")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interaction.audit(flags, "XY").collect()}
    assert rows == {("XY", 1): (2, 3, 0, 1, 4), ("XY", 2): (1, 1, 2, 1, 4), ("YX", 1): (2, 3, 0, 1, 4), ("YX", 2): (1, 1, 2, 1, 4)}
    for bad in ("", "XX", "ABCDEFG"):
        with pytest.raises(ValueError):
            interaction.audit(flags, bad)
