"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, lean

#: Hashed trigram features.
BUCKETS = 1 << 14
#: Languages whose counts a task holds at once.
HELD = 256
#: Parts of the buckets that are weighed apart, and rows of such a part that are looked at together.
SLICES, SIDE_ROWS = 64, 4096
#: Bytes of a text that are looked at together, which bounds memory on very long texts.
CHUNK = 1 << 20
#: Trigrams (some ten words) from which on more text adds no certainty. It scales a text's margins
#: alike, so it tempers the score and what counts as ambiguous but never which language is nearest.
FULL = 60
#: With more languages, one pseudorandom code is taken rather than the best of CODES (comparing costs their square).
COMPARED, CODES = 2000, 32
UNDETERMINED = "und"

#: ASCII letters are folded to lower case, other ASCII characters to a space; the rest stays.
_FOLD = np.array([ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)), dtype=np.uint32)


def features(text: str) -> Iterator[np.ndarray]:
    """The hashed byte trigrams of the whole text, in chunks. A space stands on both its sides, so each text with a letter has one."""
    raw = b" " + text.encode() + b" "
    for k in range(0, len(raw), CHUNK):
        b = _FOLD[np.frombuffer(raw[k : k + CHUNK + 2], dtype=np.uint8)]
        h = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)
        yield h >> np.uint32(18)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language, far apart from the others.

    Up to 6 languages: every way to part them in two, the exhaustive code, of
    2 ** (n - 1) - 1 bits, half of which differ between any two. From 7 on it has more bits
    than a random code needs: the best of some pseudorandom codes, of 15 bits per doubling
    of the languages (of which two differ in a quarter at least).
    """
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 6:
        bits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(bits, dtype=np.int8).T
    width, found = 15 * (n - 1).bit_length(), []
    for seed in range(CODES if n <= COMPARED else 1):
        code = np.where(np.random.default_rng(seed).random((n, width)) < 0.5, 1, -1).astype(np.int8)
        if n > COMPARED:
            return code
        product = code.astype(np.float32) @ code.T.astype(np.float32)
        found.append((int(width - (product - 2 * width * np.eye(n, dtype=np.float32)).max()) // 2, -seed, code))
    return max(found, key=lambda x: x[:2])[2]


@dataclass
class Model:
    """languages, their codewords, and weights[bucket, bit]: log odds of a trigram for the bit's sides."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Per bit, the evidence for +1: the mean log odds of the trigrams, times at most FULL."""
        total, n = np.zeros(self.code.shape[1]), 0
        for h in features(text):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / n * min(n, FULL) if n else total

    def predict(self, text: str | None, least_gap: float) -> dict:
        """The language whose codeword loses least; null texts and those without letters get UNDETERMINED.

        The loss of a bit is log(1 + exp(-margin)), so sure classifiers weigh more.
        score is the softmax of the losses; a lead under least_gap is ambiguous. Ties go
        to the first language in code point order.
        """
        if not self.languages or text is None or not any(c.isalpha() for c in text):
            return {"lang_pred": UNDETERMINED, "score": 0.0, "ambiguous": True}
        margins = self.margins(text)
        losses = np.logaddexp(0, margins).sum() - (self.code > 0) @ margins  # log(1 + exp(-m)) is log(1 + exp(m)) - m
        best = int(losses.argmin())
        share = np.exp(losses[best] - losses)
        gap = np.partition(losses, 1)[1] - losses[best] if len(losses) > 1 else np.inf
        return {"lang_pred": self.languages[best], "score": float(1 / share.sum()), "ambiguous": bool(gap < least_gap)}


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows with a text and a language: each bit's classifier is naive Bayes.

    Trigrams are counted, and each bucket's log odds found, on the executors; the driver gets
    the languages and a weight for each bucket and bit, of which there are 15 per doubling
    of the languages. Languages weigh the same, however much text they have. No rows: a
    model that knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                for h in features(text.as_py()):
                    np.add(own, np.bincount(h, minlength=BUCKETS), out=own)
                if len(sums) > HELD:
                    yield from told()
            pa.default_memory_pool().release_unused()
        yield from told()

    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = cut(known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # a language all of whose texts are empty has no bucket, and isn't known
    totals = sorted(map(tuple, counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()))
    languages, code = [x for x, _ in totals], codewords(len(totals))
    bits = code.shape[1] if languages else 0
    ones = np.maximum((code > 0).sum(axis=0), 1), np.maximum((code < 0).sum(axis=0), 1)

    def weigh(found: pd.DataFrame) -> pd.DataFrame:
        buckets, at = np.unique(found["bucket"].to_numpy(), return_inverse=True)
        share, sides = (found["n"] / found["total"]).to_numpy(), np.zeros((2, len(buckets), bits))
        for k in range(0, len(found), SIDE_ROWS):
            own = np.array(found["code"].iloc[k : k + SIDE_ROWS].tolist(), dtype=np.int8)
            for side, sign in zip(sides, (1, -1)):
                np.add.at(side, at[k : k + SIDE_ROWS], share[k : k + SIDE_ROWS, None] * (own == sign))
        plus, minus = sides[0] / ones[0], sides[1] / ones[1]
        return pd.DataFrame({"bucket": buckets, "weights": (np.log(plus + 1e-6) - np.log(minus + 1e-6)).astype(np.float32).tolist()})

    table = rows.sparkSession.createDataFrame([(x, n, c.tolist()) for (x, n), c in zip(totals, code)], "lang string, total bigint, code array<int>")
    named = join_counted(counts, table, "lang", "inner", rows=len(languages)).withColumn("slice", F.col("bucket") % SLICES)
    found = named.groupBy("slice").applyInPandas(weigh, "bucket int, weights array<float>").collect() if languages else []
    weights = np.zeros((BUCKETS, bits), dtype=np.float32)
    for r in found:
        weights[r["bucket"]] = r["weights"]
    return Model(languages, code, weights)


def predicted(model: Model, text: Column, least_gap: float = 1.0) -> Column:
    """struct(lang_pred, score, ambiguous) of a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    @lean
    def run(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t.as_py(), least_gap) for t in texts]
        return pa.array(rows, pa.struct({"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()}))

    return run(text)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row (id, held_out, lang_pred, score, ambiguous) for each row of docs.

    Learns from the texts and non-null languages of the rows that aren't held out;
    predicts from the text alone. Repeated rows are all returned; other columns are ignored, whatever their names; texts
    of any length are looked at whole, in chunks. An empty table gives
    no rows; without any labelled row every prediction is UNDETERMINED.
    """
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predicted(model, F.col(text_col)).alias("p"))
    return rows.select(id_col, "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that have a language by their text, with their columns.

    Rejected are texts without a letter, null texts, and those whose prediction is
    ambiguous. Where no row can be learned from, nothing but letters is asked for. Repeated
    rows are judged alike and stay each, an empty table gives no rows, columns of any name
    ride along, and texts of any length are looked at whole.
    """
    name = "_turnstone_language"
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    rows = docs.withColumn(name, predicted(model, F.col(text_col)))
    return rows.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & ~F.col(f"{name}.ambiguous")).select(*docs.columns)
