"""Sketches of files that are kept and merged: quantiles and distinct texts without reading a file twice, near or exact."""

from __future__ import annotations

import functools
import operator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.plans.scratch import cut, drop_scratch
from turnstone.sources import lines, records

#: Sizes of the sketches: a rank is within about 0.13 % of the rows, a distinct count within 1.6 % (each more seldom than once in a hundred times twice as far). Up to about as many rows, and 2 ** LOG_K texts, both are exact.
QUANTILE_K, LOG_K = 4000, 14
RANK_ERROR, DISTINCT_ERROR = 0.0013, 0.016


def sketched(rows: DataFrame, by: list[str], measure: Column, text: Column, file_col: str = "source_file") -> DataFrame:
    """A row for each file and value of `by`: n, a KLL sketch of the measure (a long) and a theta sketch of the texts."""
    return rows.groupBy(F.col(file_col).alias("source_file"), *by).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint(measure.cast("bigint"), QUANTILE_K).alias("measures"), F.theta_sketch_agg(text, LOG_K).alias("texts")
    )


def told_apart(rows: DataFrame, by: list[str], measure: Column, text: Column, file_col: str = "source_file") -> DataFrame:
    """A row for each file, value of `by`, measure (a long) and text (its SHA-256): how often they occur."""
    return rows.groupBy(F.col(file_col).alias("source_file"), *by, measure.cast("bigint").alias("measure"), F.unhex(F.sha2(text, 256)).alias("digest")).agg(F.count("*").alias("n"))


def add_new(spark: SparkSession, folder: str, store: str, mapping: dict[str, tuple[str, str]], by: list[str], measure: Column, text: Column, exact: str | None = None) -> int:
    """Sketch the files of a folder that the store (a Parquet folder) doesn't know yet; how many there were.

    Only those files are read. A file counts as known by its name, so it has to be complete. With exact, another
    folder, what exact answers need is kept there: it is written before the sketches, so after a failure the same rows may come twice.
    """
    found = lines.listing(spark, folder)
    known = lines.stored_files(spark, store)
    new = found if known is None else found.join(known.withColumnRenamed("source_file", "path"), "path", "left_anti")
    new = new.cache()
    try:
        n = new.count()
        if n:
            told = records.to_records(lines.read_lines(spark, folder, files=new), mapping)
            if exact is not None:
                told_apart(told, by, measure, text).write.mode("append").parquet(exact)
            sketched(told, by, measure, text).write.mode("append").parquet(store)
        return n
    finally:
        new.unpersist()


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of all files, as a row for each value of `by`: n, measures and texts."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("measures").alias("measures"), F.theta_union_agg("texts").alias("texts"))


def quantile(measures: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(measures, F.lit(share))


def distinct(texts: Column) -> Column:
    """About how many different texts a sketch has seen, rounded."""
    return F.round(F.theta_sketch_estimate(texts)).cast("bigint")


def shared(a: Column, b: Column) -> Column:
    """About how many different texts two sketches have both seen."""
    return distinct(F.theta_intersection(a, b))


def exactly(sketches: DataFrame, exact: DataFrame, by: list[str], shares: dict[str, Decimal], width: float = 3 * RANK_ERROR) -> DataFrame:
    """A row for each value of `by`: n, for each share the least measure that so many rows don't exceed, and how many different texts there are.

    sketches and exact are what add_new() has stored. The sketches say between which measures a quantile lies; those below are counted,
    and only those between are sorted. If it should lie elsewhere, width (in ranks) grows until it is found.
    """
    apart = exact.distinct()  # by file
    counts = cut(apart.where("measure IS NOT NULL").groupBy(*by, "measure").agg(F.sum("n").alias("n")))
    whole = cut(merged(sketches, by).select(*by, "measures"))
    while True:
        found = cut(_between(counts, whole, by, shares, width))
        if width >= 1 or found.where("value IS NULL").isEmpty():
            break
        drop_scratch(found)
        width = 8 * max(width, RANK_ERROR)
    drop_scratch(counts)
    drop_scratch(whole)
    totals = apart.groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("digest").alias("texts"), *[F.lit(None).cast("bigint").alias(name) for name in shares])
    placed = found.groupBy(*by).agg(F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("texts"), *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])
    return totals.unionByName(placed).groupBy(*by).agg(*[F.max(name).alias(name) for name in ("n", *shares, "texts")])


def _between(counts: DataFrame, whole: DataFrame, by: list[str], shares: dict[str, Decimal], width: float) -> DataFrame:
    """For each value of `by` and name of a share the quantile (value), null if it isn't within width of where the sketch has it."""
    at = lambda share: quantile(F.col("measures"), min(1.0, max(0.0, share)))
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.kll_sketch_get_n_bigint("measures")).cast("bigint"))
    sides = [F.struct(F.lit(name).alias("name"), rank(q).alias("rank"), at(float(q) - width).alias("low"), at(float(q) + width).alias("high")) for name, q in shares.items()]
    sought = whole.where(F.kll_sketch_get_n_bigint("measures") > 0).select(*[F.col(b).alias(f"_{b}") for b in by], F.inline(F.array(*sides)))
    same = functools.reduce(operator.and_, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
    near = counts.join(sought, same & (F.col("measure") <= F.col("high"))).groupBy(*by, "name", "rank", F.when(F.col("measure") >= F.col("low"), F.col("measure")).alias("value")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by, "name").orderBy(F.asc_nulls_first("value")))
    first = F.min(F.when(F.col("upto") >= F.col("rank"), F.struct("upto", "value")))
    return near.withColumn("upto", upto).groupBy(*by, "name").agg(first.getField("value").alias("value"))
