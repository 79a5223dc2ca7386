"""An inverted index of character trigrams over files, from which searches pick the files they have to open."""

from __future__ import annotations

import re
import string
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as ops
    from re import _parser as patterns

#: Letters are folded one by one, so that what stands around them doesn't matter; the last two are those that lower-case to ASCII letters.
UPPER, LOWER = string.ascii_uppercase + "\u212a\u0130", string.ascii_lowercase + "ki"
_FOLD = str.maketrans(UPPER, LOWER)
_FOLDED = np.array([ord(chr(k).translate(_FOLD)) for k in range(max(map(ord, UPPER)) + 1)], dtype=np.uint64)
#: Characters whose trigrams are told apart in one go.
CHARS = 1 << 20


@dataclass(frozen=True)
class Need:
    """What the trigrams of a file have to hold: all of `grams` and all of `parts`; or, with any, one of the parts."""

    grams: frozenset[str] = frozenset()
    parts: tuple[Need, ...] = ()
    any: bool = False

    def all_grams(self) -> set[str]:
        return set(self.grams).union(*(p.all_grams() for p in self.parts))

    def nothing(self) -> bool:
        return not self.grams and not self.parts

    def met(self, grams: Column) -> Column:
        """Whether an array of trigrams has what is needed."""
        if self.any:
            found = F.lit(False)
            for p in self.parts:
                found |= p.met(grams)
            return found
        found = F.lit(True)
        for g in sorted(self.grams):
            found &= F.array_contains(grams, g)
        for p in self.parts:
            found &= p.met(grams)
        return found


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def of_text(needle: str) -> Need:
    """The trigrams of every text that holds needle, letter case aside."""
    found = {g for g in _grams(needle.lower()) if g.isascii()}
    return Need(frozenset(g.translate(_FOLD) for g in found))


def _of_sequence(parsed) -> Need:
    grams, parts, run = set(), [], ""

    def end() -> None:
        nonlocal run
        grams.update(_grams(run))
        run = ""

    for op, value in parsed:
        if op is ops.LITERAL:
            run += chr(value).translate(_FOLD)
        elif op is ops.AT:  # an anchor takes no room
            continue
        elif op is ops.SUBPATTERN:
            end()
            parts.append(_of_sequence(value[3]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            end()
            if value[0] > 0:
                parts.append(_of_sequence(value[2]))
        elif op is ops.ATOMIC_GROUP:
            end()
            parts.append(_of_sequence(value))
        elif op is ops.BRANCH:
            end()
            either = tuple(_of_sequence(x) for x in value[1])
            if not any(x.nothing() for x in either):
                parts.append(Need(parts=either, any=True))
        else:
            end()
    end()
    return Need(frozenset(grams), tuple(p for p in parts if not p.nothing()))


def of_pattern(pattern: str) -> Need:
    """Trigrams of every text that a regular expression matches in; none are needed where its syntax isn't known for sure."""
    if re.search(r"\\[0-9QEpPxuUkgGRhHvVXNzZ]|\[[^\]]*(?:&&|\[)|\(\?[^:=!<>a-zA-Z]*[a-zA-Z]*x", pattern):
        return Need()
    try:
        return _of_sequence(patterns.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return Need()


def _distinct(texts: list[str]) -> list[str]:
    """The different trigrams of some texts, letters folded."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = np.where(codes < len(_FOLDED), _FOLDED[np.minimum(codes, len(_FOLDED) - 1)], codes)
    ends = np.cumsum([len(t) for t in texts])
    whole = np.ones(len(codes), bool)  # a trigram starts here and ends in the same text
    for k in (1, 2):
        whole[np.maximum(ends - k, 0)] = False
    at = np.flatnonzero(whole[:-2])
    found = np.unique(codes[at] << np.uint64(42) | codes[at + 1] << np.uint64(21) | codes[at + 2])
    told = np.stack([found >> np.uint64(42), found >> np.uint64(21), found], axis=1) & np.uint64((1 << 21) - 1)
    text = told.astype("<u4").tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)]


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, text in UTF-8) to rows (gram, file), each once for about CHARS characters of a file."""

    def row_batch(file: int, texts: list[str]) -> pa.RecordBatch:
        grams = _distinct(texts)
        return pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "file": pa.array([file] * len(grams), pa.int64())})

    for batch in batches:
        rows, files = np.argsort(batch.column(0).to_numpy(), kind="stable"), batch.column(0).to_pylist()
        held, n, last = [], 0, None
        for k in rows.tolist():
            if held and (files[k] != last or n >= CHARS):
                yield row_batch(last, held)
                held, n = [], 0
            last, text = files[k], (batch.column(1)[k].as_py() or b"").decode("utf-8", "replace")
            for begin in range(0, len(text) - 2, CHARS):
                if held and n >= CHARS:
                    yield row_batch(last, held)
                    held, n = [], 0
                held.append(text[begin : begin + CHARS + 2])
                n += len(held[-1])
        if held:
            yield row_batch(last, held)


def build(records: DataFrame, path: str, file_col: str = "source_file", text_col: str = "text") -> None:
    """Write the index of the records' texts by file: rows (gram, file), file a hash of the name, sorted by gram.

    A text costs as much as it has characters. A trigram that all files have is dealt over as many tasks as the range sort makes. Files may be added later, by another
    index in a folder beside; two names of one hash are opened together.
    """
    texts = records.select(F.xxhash64(file_col).alias("file"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.mapInArrow(posted, "gram string, file bigint").distinct()
    rows.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(path)


def candidates(spark: SparkSession, path: str, files: DataFrame, need: Need, file_col: str = "path") -> DataFrame:
    """The files (a table with their names) that may hold what is needed; only the needed trigrams' rows are read."""
    if need.nothing():
        return files
    posted = spark.read.parquet(path).where(F.col("gram").isin(sorted(need.all_grams())))
    hits = posted.groupBy("file").agg(F.collect_set("gram").alias("grams")).where(need.met(F.col("grams"))).select(F.col("file").alias("_file"))
    return files.join(hits, F.xxhash64(file_col) == F.col("_file"), "left_semi")
