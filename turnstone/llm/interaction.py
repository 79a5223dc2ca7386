"""Filter interaction audit: every order of some filters is replayed over every document's flags."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, let

GAPS = r"[\x20\x09-\x0D]+"
#: More filters have too many orders to be replayed one by one.
MOST_FILTERS = 6
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column) -> dict[str, Column]:
    """Filter: whether a text (not null) fails it by what stands in it."""

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))

    words = let(F.filter(F.split(text, GAPS), lambda w: w != ""), of_words)
    long = lambda c: c.cast("bigint")
    return {
        "A": words["n"] < 200,
        "B": 100 * long(words["distinct"]) < 50 * long(words["n"]),
        "C": 100 * long(F.regexp_count(text, F.lit("[A-Z]"))) > 2 * long(F.length(text)),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row (part, fails, good, toxic) for each row of docs, for the filters ABCDE.

    fails: bit k is set if the document fails the k-th filter. E is failed by a text that a smaller
    id has, too, whatever else fails it; rows of one id and text don't fail each other, and a row
    without an id doesn't fail E, nor does its text fail others. Texts are told
    apart by their SHA-256; null ones count as ''. A null part counts as ''. good and toxic: whether some label of that
    id says quality = 1 or toxic = 1. Long texts are looked at whole, each in one task; an empty table gives
    no rows; other columns are ignored, on both sides.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(text).values())]
    mask = own[0].bitwiseOR(own[1]).bitwiseOR(own[2]).bitwiseOR(own[3])
    rows = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("fails")))
    copied = cut(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").select("digest", "least"))
    named = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    named = cut(named.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id"))
    told = join_counted(join_counted(rows, copied, "digest"), named, "id")
    again = F.when(F.col("id") > F.col("least"), 1 << len(own)).otherwise(0)
    return told.select("part", F.col("fails").bitwiseOR(again).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(flags: DataFrame, filters: str) -> DataFrame:
    """A row (filter_order, m0, m1, ...) for each order of the filters; m0 is the first one's bit."""
    rows = [("".join(order), *[1 << filters.index(f) for f in order]) for order in itertools.permutations(filters)]
    return flags.sparkSession.createDataFrame(rows, "filter_order string, " + ", ".join(f"m{k} int" for k in range(len(filters))))


def audit(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row (part, filter_order, step, counts) for each part of flags, order of the filters and step (from 1).

    flags: rows (part, fails, good, toxic) as flagged() gives them; filters: a letter for each bit of
    fails. Each document meets each order (a broadcast table, of as many rows as there
    are orders), in which the first filter that it fails removes it. kept: documents left after the step;
    removed: by it; redundant: they fail its filter but are gone already; unique_fails: they fail
    its filter alone; good_lost, toxic_lost: of the removed, those so named; shapley: what the
    step's filter removes, summed over all orders. Parts have all their rows, zeros
    included; tasks add their documents up before anything is shuffled, so a
    part that most documents share is no task's work. No documents: no rows.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len(set(filters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} different filters are audited")
    masks = [F.col(f"m{k}") for k in range(n)]
    first = F.coalesce(*[F.when(F.col("fails").bitwiseAND(m) != 0, k) for k, m in enumerate(masks)], F.lit(n))
    replayed = flags.crossJoin(F.broadcast(orders(flags, filters))).select("*", first.alias("first"))
    steps = replayed.select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode(F.array(*masks)).alias("at", "mask"))
    here, before = F.col("first") == F.col("at"), F.col("first") < F.col("at")
    counted = steps.groupBy("part", "filter_order", "at", "mask").agg(
        F.count_if(F.col("first") > F.col("at")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(before & (F.col("fails").bitwiseAND(F.col("mask")) != 0)).alias("redundant"),
        F.count_if(F.col("fails") == F.col("mask")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    counted = cut(counted)
    shares = cut(counted.groupBy("part", "mask").agg(F.sum("removed").alias("shapley")))
    return join_counted(counted, shares, ["part", "mask"], "inner").select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), *COUNTS, "shapley")
