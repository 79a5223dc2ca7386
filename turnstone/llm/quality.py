"""Quality rules that vote or abstain, weighed by expectation-maximisation; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

GAPS = r"[\x20\x09-\x0D]+"
WINDOW = 8
GOOD, BAD = 1, -1

#: rule: (measure, good at or under, bad over); between the two it abstains.
AT_MOST = {
    "symbols": ("symbols_per_word", 0.02, 0.1),
    "symbol_words": ("symbol_word_share", 0.02, 0.1),
    "repeats": ("repeat_share", 0.1, 0.3),
    "dup_lines": ("dup_line_share", 0.1, 0.34),
    "echoes": ("echo_share", 0.05, 0.2),
    "capitals": ("capital_share", 0.12, 0.35),
}
#: rule: (measure, good from, bad under).
AT_LEAST = {
    "letters": ("letter_word_share", 0.9, 0.75),
    "variety": ("distinct_share", 0.5, 0.35),
    "length": ("n_words", 50, 20),
}
RULES = [*AT_MOST, *AT_LEAST]


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows of WINDOW word hashes that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:  # words in the union of the windows at these sorted starts
        steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def shared(pairs: Column) -> Column:  # sorted by hash: a window occurs again just if a neighbour equals it
        again = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return let(F.sort_array(F.transform(again, lambda p: p["i"])), covered)

    def any_shared(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(pairs, shared))

    return F.when(F.size(hashes) < WINDOW, 0).otherwise(let(windows, any_shared)).cast("bigint")


def measures(text: Column) -> Column:
    """A struct of the counts and shares that the rules look at; null text counts as ''."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            echoes = F.aggregate(F.transform(hashes, lambda h, i: F.when(F.get(hashes, i - 1) == h, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
            return F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                _repeated(hashes).alias("n_repeat_words"),
                F.size(F.array_distinct(hashes)).cast("bigint").alias("n_distinct"),
                echoes.cast("bigint").alias("n_echoes"),
            )

        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(F.filter(F.split(whole, GAPS), lambda w: w != ""), of_words).alias("w"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]+")).cast("bigint").alias("n_symbol_runs"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.regexp_count(whole, F.lit(r"\p{L}[^\x20\x09-\x0D]*")).cast("bigint").alias("n_letter_words"),
    )


def measured(text: Column) -> Column:
    """The measures as a flat struct, with base_failed and the shares that the rules judge."""
    return let(measures(text), _flat)


def _flat(m: Column) -> Column:
    words, lines = F.greatest(m["w"]["n_words"], F.lit(1)), F.greatest(m["l"]["n_lines"], F.lit(1))
    n, repeat = m["w"]["n_words"], m["w"]["n_repeat_words"]
    return F.struct(
        n.alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        ((n < 20) | (100 * repeat > 30 * n)).alias("base_failed"),
        (m["n_symbols"] / words).alias("symbols_per_word"),
        (m["n_symbol_runs"] / words).alias("symbol_word_share"),
        (repeat / words).alias("repeat_share"),
        (m["l"]["n_dup_lines"] / lines).alias("dup_line_share"),
        (m["w"]["n_echoes"] / words).alias("echo_share"),
        (m["n_capitals"] / F.greatest(m["w"]["word_chars"], F.lit(1))).alias("capital_share"),
        (m["n_letter_words"] / words).alias("letter_word_share"),
        (m["w"]["n_distinct"] / words).alias("distinct_share"),
    )


def votes(m: Column) -> dict[str, Column]:
    """Each rule's vote on a struct of measured(): GOOD, BAD or 0 (the rule abstains)."""
    under = {r: F.when(m[x] > bad, BAD).when(m[x] <= good, GOOD).otherwise(0) for r, (x, good, bad) in AT_MOST.items()}
    return under | {r: F.when(m[x] < bad, BAD).when(m[x] >= good, GOOD).otherwise(0) for r, (x, good, bad) in AT_LEAST.items()}


def _named(found: dict[str, Column]) -> list[Column]:
    return [v.alias(r) for r, v in found.items()]


@dataclass
class Accuracies:
    """prior: the share of good documents. bad_if_good[r] and bad_if_bad[r]: how often
    rule r, where it votes, votes BAD on a good and on a bad document."""

    prior: float
    bad_if_good: dict[str, float]
    bad_if_bad: dict[str, float]

    def posterior(self, found: dict[str, Column] | None = None) -> Column:
        """The probability that a document is good, from its votes (the rules' columns, if none are given)."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for r in RULES:
            p, q = self.bad_if_good[r], self.bad_if_bad[r]
            vote = found[r] if found else F.col(r)
            odds += F.when(vote == BAD, math.log(p / q)).when(vote == GOOD, math.log((1 - p) / (1 - q))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def learn(rows: DataFrame, rounds: int = 30, tolerance: float = 1e-6) -> Accuracies:
    """Expectation-maximisation over all rows with vote columns; no labels are used.

    Spark folds the rows into vote patterns, of which there are 3 ** rules at most; the
    rounds run over these alone, so they cost the same at any size. Abstentions carry no
    weight. The start says that most documents are good and that rules are more often right
    than wrong; a rule that would turn out better than chance backwards is held at no
    weight. No rows: the start.
    """
    patterns = np.array([tuple(r) for r in rows.groupBy(*RULES).count().collect()], dtype=float).reshape(-1, len(RULES) + 1)
    vote, n = patterns[:, :-1], patterns[:, -1]
    bad, said = vote == BAD, vote != 0
    prior, p, q = 0.8, np.full(len(RULES), 0.005), np.full(len(RULES), 0.15)
    for _ in range(rounds if len(n) else 0):
        odds = np.log(prior / (1 - prior)) + bad @ np.log(p / q) + (vote == GOOD) @ np.log((1 - p) / (1 - q))
        good = n / (1 + np.exp(-odds))
        old, prior = (prior, q), min(max(good.sum() / n.sum(), 0.01), 0.99)
        # as if a few votes had been seen before
        mine, theirs = (good @ bad + 0.05) / (good @ said + 1), ((n - good) @ bad + 0.5) / ((n - good) @ said + 1)
        p, q = np.clip(mine, 1e-6, 0.999), np.clip(np.maximum(mine, theirs), 1e-6, 0.999)
        if max(abs(prior - old[0]), np.abs(q - old[1]).max()) < tolerance:
            break
    return Accuracies(float(prior), dict(zip(RULES, p.tolist())), dict(zip(RULES, q.tolist())))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per row of docs: the id, the measured counts, base_failed, p_good and kept.

    kept: base_failed is false and the posterior probability of a good document is
    at least threshold. A null or empty text has no words and fails the base. An empty
    table gives no rows. Repeated rows, null ids and other columns change nothing. A
    very long text is measured whole; it has to fit into a task's memory some times over.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    looked = docs.select(F.col(id_col).alias("id"), measured(F.col(text_col)).alias("m"))
    rows = cut(looked.select("id", *[f"m.{c}" for c in base], *_named(votes(F.col("m")))))
    judged = rows.withColumn("p_good", learn(rows).posterior())
    kept = (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept")
    return judged.select(F.col("id").alias(id_col), *base, kept, "p_good")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns.

    Null and empty texts go, repeated rows are judged alike and stay each, columns of any
    name ride along, and an empty table gives no rows. Texts are measured once: docs is
    written to the shared folder with its votes, of which the accuracies are learned.
    A text has to fit into a task's memory some times over.
    """
    name = "_turnstone_votes"
    seen = F.struct(F.col(name)["base_failed"].alias("base_failed"), *_named(votes(F.col(name))))
    voted = cut(docs.withColumn(name, measured(F.col(text_col))).withColumn(name, seen))
    learned = learn(voted.select(f"{name}.*"))
    found = {r: F.col(name)[r] for r in RULES}
    return voted.where(~F.col(name)["base_failed"] & (learned.posterior(found) >= threshold)).drop(name)
