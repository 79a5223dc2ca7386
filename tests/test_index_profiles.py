"""Trigram index, deep pages, path profiles, stored sketches and exactly-once streams against plain Python."""

import json
import random
import re
import shutil
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnstone.operators import paging, profiles, sketches, textindex
from turnstone.sources import lines
from turnstone.streaming import follow


@pytest.mark.parametrize("range_rows", [7, 100, 10**6])
def test_pages(spark, range_rows):
    rng = random.Random(range_rows)
    rows = [(rng.choice([None, *range(30)]), rng.choice("abc"), k) for k in range(500)] + [(5, "b", 1000 + k) for k in range(200)]
    table = spark.createDataFrame(rows, "a int, b string, c int")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for offset, n in ((0, 10), (340, 25), (690, 30), (700, 5), (10**6, 5), (5, 0), (0, 700)):
        assert list(map(tuple, paging.page(table, ["a", "b", "c"], offset, n, range_rows).collect())) == want[offset : offset + n]
    assert [r[:2] for r in paging.page(table, ["a", "b"], 200, 9, range_rows).select("a", "b").collect()] == [r[:2] for r in want[200:209]]
    assert paging.page(table.where("false"), ["a"], 0, 3).collect() == []


PATTERNS = ["needle", "ne+dle", "n(ee)?dle", "(nee|ne)dle", "needle|pin stack", "(?:abc|de)f", "[nN]eedle", "nee.*stack", "^needle", r"needle\b", "nee(?=dle)dle", "a{2}bcd", "(?i)NEEDLE", r"\x6eeedle", r"\p{L}eedle", "(abc){0,2}needle", "(abc)+", "", "ab", "né|ñandú", "x(?!y)needle", "(?x) nee dle", "[a-c&&[b]]bcd", r"\Qneedle\E"]


def test_no_match_is_lost_by_the_index(spark):
    """Whatever a pattern matches in has the trigrams that the pattern needs (Java's own matching judges)."""
    rng = random.Random(4)
    bits = ["needle", "ndle", "nedle", "pin stack", "abcf", "def", "Needle", "nee hay stack", "aabcd", "NEEDLE", "abcneedle", "né", "ñandú", "xneedle", "bbcd", "ab", "", "zzz", "neeDLE", "Kelvin", "İn"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(4))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    folded = F.translate("text", textindex.UPPER, textindex.LOWER)
    grams = F.when(F.length(folded) > 2, F.transform(F.sequence(F.lit(1), F.length(folded) - 2), lambda k: F.substring(folded, k, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    for pattern in PATTERNS:
        lost = table.where(F.col("text").rlike(pattern) & ~textindex.of_pattern(pattern).met(grams))
        assert lost.count() == 0, pattern
    for needle in ("needle", "NEEDLE", "kelv", "in", "ñan", "ndú x", "in n"):
        low = F.contains(F.lower("text"), F.lit(needle.lower()))
        assert table.where(low & ~textindex.of_text(needle).met(grams)).count() == 0, needle
    assert textindex.of_pattern("needle").grams == {"nee", "eed", "edl", "dle"}
    assert textindex.of_pattern("(needle|pin)").parts[0].parts[0].any
    assert textindex.of_pattern(r"\p{L}needle").nothing() and textindex.of_pattern("(needle|.)").nothing()


def test_searches_open_few_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(40):
        (logs / f"{k}").write_text("".join(f"line {k} {n} {'needle' if k % 13 == 0 and n == 3 else 'hay'}\n" for n in range(9)))
    whole = lines.read_lines(spark, str(logs)).withColumnRenamed("value", "text")
    textindex.build(whole, str(tmp_path / "index"))
    listing = lines.listing(spark, str(logs))
    found = textindex.candidates(spark, str(tmp_path / "index"), listing, textindex.of_pattern("ne+dle"))
    assert sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["0", "13", "26", "39"]
    hits = lines.read_lines(spark, str(logs), files=found).where(F.col("value").rlike("ne+dle"))
    assert sorted((r.source_file, r.line_no, r.value) for r in hits.collect()) == sorted((r.source_file, r.line_no, r.text) for r in whole.where(F.col("text").rlike("ne+dle")).collect())
    assert textindex.candidates(spark, str(tmp_path / "index"), listing, textindex.of_text("nowhere")).count() == 0


def test_trigrams_of_texts_of_any_length(spark, tmp_path, monkeypatch):
    """The index against plain Python, in pieces of any size; and a text costs as much as it has characters (seconds here; hours if each trigram cost the whole text)."""
    rng = random.Random(8)
    rows = [(f"f{rng.randrange(9)}", None if rng.random() < 0.1 else "".join(rng.choice("abAB Kİé\U0001f600\n\0") for _ in range(rng.randrange(40)))) for _ in range(400)]
    want = {(f, t.translate(textindex._FOLD)[k : k + 3]) for f, t in rows if t for k in range(len(t) - 2)}
    table = pa.RecordBatch.from_pydict({"file": [int(f[1:]) for f, _ in rows], "text": [None if t is None else t.encode() for _, t in rows]})
    for chars in (1, 7, 1 << 20):
        monkeypatch.setattr(textindex, "CHARS", chars)
        assert {(f"f{r['file']}", r["gram"]) for b in textindex.posted(iter([table])) for r in b.to_pylist()} == want
    monkeypatch.undo()
    words = [f"{k:x}" for k in range(200_000)]
    long = spark.createDataFrame([("long", " ".join(words)), ("none", None)], "source_file string, text string").repartition(2)
    textindex.build(long, str(tmp_path / "long"))
    text = " ".join(words)
    found = [r.gram for r in spark.read.parquet(str(tmp_path / "long")).collect()]
    assert len(found) == len(set(found)) and set(found) == {text[k : k + 3] for k in range(len(text) - 2)}


def unfolded(value, path, out):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    out.append((path, kind))
    if isinstance(value, dict):
        for k, v in value.items():
            unfolded(v, path + ("." + k if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else "." + json.dumps(k, ensure_ascii=False)), out)
    elif isinstance(value, list):
        for v in value:
            unfolded(v, path + "[]", out)


def test_paths_at_every_depth(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(7 if depth < 6 else 4)
        if kind < 4:
            return rng.choice([1, 2.5, "x", "", True, None, 10**20])
        if kind < 6:
            return {k: value(depth + 1) for k in rng.sample(["a", "b", "odd key", 'qu"ote', "é", "A1"], rng.randrange(4))}
        return [value(depth + 1) for _ in range(rng.randrange(4))]

    bodies = [value(0) for _ in range(80)]
    rows = [(f"f{k % 3}", json.dumps(b, ensure_ascii=False)) for k, b in enumerate(bodies)] + [("f9", "{broken"), ("f9", None)]
    want = {}
    for (file, _), b in zip(rows, bodies):
        out = []
        unfolded(b, "$", out)
        for key in out:
            n, low, high = want.get(key, (0, file, file))
            want[key] = (n + 1, min(low, file), max(high, file))
    found = profiles.path_profile(spark.createDataFrame(rows, "source_file string, body string"), "body").collect()
    assert {(r.path, r.kind): (r.n, r.first_file, r.last_file) for r in found} == want
    assert profiles.path_profile(spark.createDataFrame([], "source_file string, body string"), "body").count() == 0


def test_sketches_keep_their_errors_and_read_new_files_alone(spark, tmp_path):
    folder, store, rng = tmp_path / "logs", str(tmp_path / "store"), random.Random(1)
    mapping = {"role": ("$.role", "string"), "n": ("$.n", "bigint"), "text": ("$.text", "string")}
    values = {"u": [], "a": []}
    folder.mkdir()

    def add(name, count):
        with (folder / name).open("w") as f:
            for _ in range(count):
                role, n, text = rng.choice("ua"), int(rng.paretovariate(1) * 100), f"t{rng.randrange(40_000)}"
                values[role].append((n, text))
                f.write(json.dumps({"role": role, "n": n, "text": text}) + "\n")

    add_new = lambda: sketches.add_new(spark, str(folder), store, mapping, ["role"], F.col("n"), F.col("text"))
    for k in range(3):
        add(f"{k}.jsonl", 20_000)
    assert add_new() == 3 and add_new() == 0
    (folder / "0.jsonl").write_text("what is known isn't read again\n")
    add("3.jsonl", 30_000)
    assert add_new() == 1
    whole = sketches.merged(spark.read.parquet(store), ["role"])
    shares = (0.01, 0.25, 0.5, 0.9, 0.999)
    for r in whole.select("role", "n", sketches.distinct(F.col("texts")).alias("texts"), *[sketches.quantile(F.col("measures"), q).alias(f"q{k}") for k, q in enumerate(shares)]).collect():
        own = values[r.role]
        assert r.n == len(own)
        exact = len({t for _, t in own})
        assert abs(r.texts - exact) <= 3 * sketches.DISTINCT_ERROR * exact
        for k, q in enumerate(shares):
            low, high = (sum(x < r[f"q{k}"] for x, _ in own) / len(own), sum(x <= r[f"q{k}"] for x, _ in own) / len(own))
            assert low - 3 * sketches.RANK_ERROR <= q <= high + 3 * sketches.RANK_ERROR
    both = whole.groupBy().pivot("role", ["u", "a"]).agg(F.first("texts"))
    exact = len({t for _, t in values["u"]} & {t for _, t in values["a"]})
    assert abs(both.select(sketches.shared(F.col("u"), F.col("a")).alias("x")).first().x - exact) <= 6 * sketches.DISTINCT_ERROR * exact


@pytest.mark.parametrize("width", [0.0, 3 * sketches.RANK_ERROR])
def test_more_rows_than_sketches_hold_are_told_exactly(spark, tmp_path, width):
    folder, store, exact, rng = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "exact"), random.Random(3)
    mapping = {"role": ("$.role", "string"), "n": ("$.n", "bigint"), "text": ("$.text", "string")}
    shares = {"q0": Decimal("0.0"), "q1": Decimal("0.1"), "q50": Decimal("0.5"), "q90": Decimal("0.9"), "q100": Decimal("1.0")}
    rows = []
    folder.mkdir()
    for k in range(2):
        own = [(rng.choice(["u", None, "few"][: 2 + (j < 9)]), rng.randrange(10**9), f"t{rng.randrange(90_000)}") for j in range(60_000)] + [("none", None, None)]
        (folder / f"{k}.jsonl").write_text("".join(json.dumps(dict(zip(mapping, r))) + "\n" for r in own))
        rows += own
        assert sketches.add_new(spark, str(folder), store, mapping, ["role"], F.col("n"), F.col("text"), exact) == 1
    spark.read.parquet(exact).where("source_file LIKE '%1.jsonl'").write.mode("append").parquet(exact)  # as after a failure
    found = sketches.exactly(spark.read.parquet(store), spark.read.parquet(exact), ["role"], shares, width)
    want = set()
    for role in {r[0] for r in rows}:
        own = sorted(n for r, n, _ in rows if r == role and n is not None)
        cuts = [own[max(1, -(-int(10 * q) * len(own) // 10)) - 1] if own else None for q in shares.values()]
        want.add((role, sum(r[0] == role for r in rows), *cuts, len({t for r, _, t in rows if r == role and t is not None})))
    assert {tuple(r[c] for c in ("role", "n", *shares, "texts")) for r in found.collect()} == want


def test_replayed_batches_and_renamed_files_add_nothing(spark, tmp_path):
    logs, sink, checkpoint = tmp_path / "logs", str(tmp_path / "sink"), tmp_path / "ckpt"
    logs.mkdir()
    run = lambda: follow.once(follow.new_files(spark, str(logs)).select("modified", "value"), sink, str(checkpoint), ["value"])
    values = lambda: sorted(r.value for r in follow.committed(spark, sink).collect())
    (logs / "a").write_text("1\n2\n2\n3\n")
    run()
    assert values() == ["1", "2", "3"]
    shutil.copy(logs / "a", logs / "renamed")
    (logs / "b").write_text("3\n4\n")
    run()
    assert values() == ["1", "2", "3", "4"]
    # the last batch was written, but the stream died before it could note so: it is replayed
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert values() == ["1", "2", "3", "4"]
    # a batch that died before its commit record counts for nothing
    spark.createDataFrame([("half",)], "value string").write.parquet(f"{sink}/rows/batch=999")
    assert values() == ["1", "2", "3", "4"]
