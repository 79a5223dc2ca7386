"""Pieces against whole-text tokenization, and the segment tree against a plain best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstone.llm import packing, queries

SCHEMA = "doc_id bigint, text string, lang string, start string, length int, ids string, copy int, pack int"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", "x", 1, "y", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.WORD_BPE)


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(lengths):
    where, at = packing.best_fit_decreasing(lengths, 64)
    room = {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):  # tried against every open window
        fits = [r for r in room.values() if r >= lengths[k]]
        if where[k] in room:
            assert room[where[k]] == min(fits) and at[k] == 64 - room[where[k]]
        else:
            assert not fits and at[k] == 0
        room[where[k]] = room.get(where[k], 64) - lengths[k]
    assert all(r >= 0 for r in room.values())


def test_every_id_of_every_document(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: encoded(tokenizer, r.text) for r in docs.collect()}
    placed = packing.pack_documents(docs, queries.WORD_BPE, end_id=2).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in placed:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length <= packing.WINDOW and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, ids))
        windows[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in want.items():
        found = sorted(pieces.pop(doc_id))
        assert [x for start, part in found for x in part] == ids
        assert all(len(part) == packing.WINDOW for _, part in found[:-1])
    assert not pieces
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    tokens = sum(map(len, want.values()))
    assert len(windows) <= 1.02 * tokens / packing.WINDOW + 1
    checked = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op10_packing(spark, SF).collect()}
    assert checked == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in placed}
    padded = {r.sequence_id: r.input_ids for r in packing.sequences(packing.pack_documents(docs, queries.WORD_BPE, end_id=2)).collect()}
    assert all(len(x) == packing.WINDOW for x in padded.values()) and len(padded) == len(windows)
    assert sum(np.count_nonzero(np.array(x) == 2) for x in padded.values()) >= len(want)


def words(rng):
    letters = "abcXYZİΣ019éÜßñ\u0307\u0308\u0338中文ﬁ'’.,!?-_<|>endoftext  ̀﻿"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60)))


def test_word_by_word_ids_are_those_of_whole_texts(tokenizer):
    rng = random.Random(2)
    texts = [words(rng) for _ in range(400)] + ["it's we'll I'M DON'T o ' s", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "tab\tnew\nline\x0bv\x0cf\rr", "\x1c\x1d\x1e\x1f\x85 x", "\x00nul\x00", "İstanbul ǅ Ω K", "ALİ.", "DEVLETİ, SON", "(İ) i̇! I\u0307\u0307?"]
    ids = packing.WordIds(queries.WORD_BPE)
    assert set("azéßÿ") <= set(map(chr, ids.letters))
    texts += ["".join(rng.choice("abcdeßéñüøÿ") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["x" * 5000, "é" * 3000, "÷", "a÷b", "ŉ", "é", "naïve", "ÀÉ"]
    texts += [stem + end for stem in ("cat", "don't", "x1", "é", "Σ", "á", ")", "it'", "'", "") for end in (",", "'", "'s", "''", ").", "$$$", "...", "≠", "|>", "<|", "<|endoftext|>", ".'ll")]
    for got, text in zip(ids(pa.array(texts)), texts):
        assert np.frombuffer(got, dtype="<u4").tolist() == encoded(tokenizer, text)[:-1], repr(text)


def test_every_code_point_beside_letters_digits_and_symbols(tokenizer):
    ids = packing.WordIds(queries.WORD_BPE)
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts = [f"ab{c}cd. x{c}! 7{c}), {c}. A{c}a\u0307; {c}\u0301,{c}" for c in map(chr, points[k : k + 4000])]
        want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in ids(pa.array(texts))]
        assert got == want, [(t, g, w) for t, g, w in zip(texts, got, want) if g != w][:5]


def test_capitals_whose_small_letters_alone_have_a_composed_form(tokenizer):
    texts = [f"{before}{c}{mark}{after}" for c in "JHTWYjhtwyI" for mark in "\u0308\u030a\u030c\u0331\u0344\u0307" for before in ("", "see A", "THE ") for after in ("", "a,", "\u0323B")]
    got = packing.WordIds(queries.WORD_BPE)(pa.array(texts))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [encoded(tokenizer, t)[:-1] for t in texts]
    assert np.frombuffer(packing.WordIds(queries.WORD_BPE)(pa.array(["J\u030c"]))[0], dtype="<u4").tolist() == [329, 136, 490]


def test_known_words_age(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    ids = packing.WordIds(queries.WORD_BPE)
    for k in range(30):
        text = f"always here {k} {k % 3} word{k}"
        assert np.frombuffer(ids(pa.array([text]))[0], dtype="<u4").tolist() == encoded(tokenizer, text)[:-1]
        assert len(ids.young) <= 5 + 6


def test_odd_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (3, "other"), (4, "long text " * 9000), (5, " \n\t ")]
    placed = packing.pack_documents(table(spark, rows), queries.WORD_BPE, end_id=2, derive={"crc": F.crc32("ids")}).collect()
    found, want = defaultdict(int), defaultdict(int)
    for r in placed:
        found[r.doc_id] += r.length
    for i, t in rows:
        want[i] += len(encoded(tokenizer, t))
    assert found == want
    assert {r.doc_tokens for r in placed if r.doc_id in (1, 2, 5)} == {1}
    assert packing.pack_documents(table(spark, []), queries.WORD_BPE, end_id=2).count() == 0


def test_whole_text_tokenizers_can_be_used(spark):
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "Two  spaces\n\n and CASE"), (2, None)]
    got = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in packing.pack_documents(table(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), end_id=queries.BYTE_BPE_IDS, per_word=False).collect()}
    assert got == {1: [*byte.encode(rows[0][1]).ids, queries.BYTE_BPE_IDS], 2: [queries.BYTE_BPE_IDS]}


def test_many_groups_leave_little_padding(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).cast("int")).alias("text"))
    placed = packing.pack_documents(rows, queries.WORD_BPE, end_id=2, group=2000)
    n = placed.agg(F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("windows")).first()
    assert n.windows * packing.WINDOW <= 1.01 * n.tokens
