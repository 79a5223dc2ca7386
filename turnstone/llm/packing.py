"""Packing documents into fixed token windows: best fit decreasing over a segment tree."""

from __future__ import annotations

import array
import functools
import itertools
import os
import re
import string
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, lean, slices

WINDOW = 4096
#: Pieces that are packed together; each group is one task's work and leaves at most a few windows unfilled.
GROUP = 4096
#: Words of a generation whose ids a task keeps; there are two.
CACHE = 100_000
#: Bytes of text that are tokenized together.
SLICE = 1 << 21
#: The start of every special token's string.
MARK = "<|"
SYMBOLS = string.punctuation
#: Runs of lower-case Latin letters, which most words are.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+").fullmatch


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts, for a tokenizer that never joins what white space parts.

    So a text's ids are those of its words, and frequent words are encoded once. A
    word's closing symbols are looked up apart where the tokenizer itself, asked about
    what stands before them, starts a new token there. Words of ASCII characters are
    lower-cased beforehand (the tokenizer does so anyway), unless they may hold the string
    of a special token; nor is such a word taken apart. Other words aren't: some
    capitals have no precomposed form with a mark that their small letter has one with,
    and the tokenizer composes before it lower-cases. Words of plain letters go
    straight to the tokenizer's model. Words are kept in two
    generations: when the young one is full, it becomes the old one, and of that
    only what occurs again lives on.
    """

    def __init__(self, path: str):
        self.tokenizer, self.young, self.old = _tokenizer(path), {}, {}
        self.model, self.letters, self.closing = self.tokenizer.model, _letters(self.tokenizer), {}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers; a null text has none."""
        if sys.byteorder != "little":
            raise NotImplementedError("ids are kept as the machine has them, which is taken to be little-endian")
        texts = texts.fill_null("")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary
        known = pc.if_else(pc.and_not(pc.string_is_ascii(known), pc.match_substring(known, MARK)), pc.ascii_lower(known), known)
        ids = pa.array(self._of(known.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.array(words.offsets)].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in itertools.pairwise(ends)]

    def _of(self, words: list[str]) -> list[bytes]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        young, old, new, parted = self.young, self.old, [], []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                    continue
                stem = w.rstrip(SYMBOLS)
                if len(stem) < len(w) and stem and MARK not in w and self._closes(stem):
                    end = w[len(stem) :]
                    parted.append((w, stem, end))
                    if stem not in young:
                        new.append(stem)
                    if end not in young:
                        new.append(end)
                else:
                    new.append(w)
        rest = []
        for w in new:
            if w not in young:
                if self.letters and PLAIN(w):
                    young[w] = array.array("I", [t.id for t in self.model.tokenize(w.translate(self.letters))]).tobytes()
                else:
                    rest.append(w)
        rest = list(dict.fromkeys(rest))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            young[w] = array.array("I", e.ids).tobytes()
        for w, stem, end in parted:
            young[w] = young[stem] + young[end]
        return list(map(young.__getitem__, words))

    def _closes(self, stem: str) -> bool:
        """Whether an ASCII symbol after this stem starts a new token, as the tokenizer says of its last character alone.

        A mark, which may be composed with what stands before it, counts as not sure to.
        """
        last = stem[-1]
        if last not in self.closing:
            self.closing[last] = _spelled(self.tokenizer, f"{last}.")[-1:] == ["."] and unicodedata.category(last)[0] in "LN"
        return self.closing[last]


def _spelled(tokenizer: Tokenizer, text: str) -> list[str]:
    """The parts of a text that the tokenizer hands to its model one by one; none if it can't tell."""
    if not (tokenizer.normalizer and tokenizer.pre_tokenizer):
        return []
    return [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]


def _letters(tokenizer: Tokenizer) -> dict[int, str]:
    """How the tokenizer spells each lower-case Latin letter for its model, if it spells runs of them letter by letter."""
    letters = [chr(c) for c in range(0x100) if PLAIN(chr(c))]
    found = {ord(c): "".join(_spelled(tokenizer, c)) for c in letters}
    whole = "".join(found.values())
    return found if whole and _spelled(tokenizer, "".join(letters)) == [whole] else {}


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", per_word: bool = True) -> DataFrame:
    """A row (id, start, length, ids, doc_tokens, copy) for each piece of each document.

    A document is its text's ids by the tokenizer file, then end_id; one of more than
    `window` ids is cut into full windows and a rest. ids: binary, little-endian
    unsigned 32-bit. A null or empty text has just end_id. per_word: WordIds fits the
    tokenizer. copy tells apart rows with the same id.
    """

    @F.arrow_udf("array<struct<start: bigint, length: bigint, ids: binary>>")
    @lean
    def run(texts: pa.Array) -> pa.Array:
        encode = _word_ids(tokenizer) if per_word else lambda some: [np.array(_tokenizer(tokenizer).encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in some.to_pylist()]
        last, kind, out = np.array([end_id], dtype="<u4").tobytes(), pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "ids": pa.binary()})), []
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0), SLICE):
            whole = [ids + last for ids in encode(texts[a:b])]
            out.append(pa.array([[{"start": k // 4, "length": len(ids[k : k + 4 * window]) // 4, "ids": ids[k : k + 4 * window]} for k in range(0, len(ids), 4 * window)] for ids in whole], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    found = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("copy"), run(text_col).alias("found"))
    found = found.withColumn("doc_tokens", F.aggregate("found", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]))
    return found.select("id", "copy", "doc_tokens", F.explode("found").alias("p")).select("id", "p.start", "p.length", "p.ids", "doc_tokens", "copy")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over 0 .. window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.of: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window_id: int) -> None:
        self._add(room, 1)
        self.of.setdefault(room, []).append(window_id)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least room of at least length, taken out: (room, window)."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.of[room].pop()


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """The window and the offset there of each piece, the longest pieces placed first."""
    where, at, opened, free = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room, home = free.take(lengths[k]) or (window, opened)
        opened += home == opened
        where[k], at[k] = home, window - room
        if room > lengths[k]:
            free.put(room - lengths[k], home)
    return where, at


def assign(found: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """found (rows with length, at most window) with sequence_id and offset.

    The pieces are dealt by hash into groups of about `group`, each packed on its own
    by best fit decreasing; so the work is spread at any size, and a group's last
    windows are all that stays open. Other columns, such as the ids, ride along.
    """
    n = -(-found.count() // group) or 1
    keys = [c for c in ("id", "start", "copy") if c in found.columns]
    dealt = found.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(n)))
    schema = dealt.drop("pack").schema.simpleString()[len("struct<") : -1]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(keys, na_position="first", kind="stable")
        where, at = best_fit_decreasing(rows["length"].tolist(), window)
        first = int(rows["pack"].iloc[0]) << 32
        return rows.drop(columns="pack").assign(sequence_id=[first + w for w in where], offset=at)

    return dealt.groupBy("pack").applyInPandas(pack, f"{schema}, sequence_id: bigint, offset: bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, derive: dict[str, Column] | None = None, group: int = GROUP, **options) -> DataFrame:
    """A row (id, start, length, doc_tokens, sequence_id, offset, ids) for each piece of docs.

    sequence_id: a window of `window` ids, unique over all; its pieces fill it from
    offset 0 without gaps. start: the document's ids before the piece. With derive (names
    and expressions over the pieces' columns), those stand in the place of the ids, which
    then aren't shuffled. Null ids and repeated rows are documents like any other, a null or
    empty text has just its end id, and a very long one becomes many pieces, its ids held in
    one task; other columns are ignored, and an empty table gives no rows.
    """
    id_col = options.get("id_col", "doc_id")
    found = pieces(docs, tokenizer, end_id, window, **options)
    if derive is not None:
        found = found.withColumns(derive).drop("ids")
    placed = assign(cut(found), window, group).drop("copy")
    return placed.withColumnRenamed("id", id_col)


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """A row (sequence_id, input_ids) per window: its pieces' ids by offset, padded to `window`.

    placed: rows (sequence_id, offset, ids) as pack_documents() gives them, of which a window has `window` ids at most, however
    long its documents are. An empty table gives no rows; other columns are ignored.
    """
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    @F.arrow_udf("array<int>")
    @lean
    def run(parts: pa.Array) -> pa.Array:
        joined = [np.frombuffer(b"".join(p["ids"] for p in row.as_py()), dtype="<i4") for row in parts]
        return pa.array([np.pad(x, (0, window - len(x)), constant_values=pad_id) for x in joined], pa.list_(pa.int32()))

    return rows.select("sequence_id", run("parts").alias("input_ids"))
