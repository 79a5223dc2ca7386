"""A corpus pipeline of the training-data operators: each stage reads what the one before it kept.

A stage's rows are written before a later stage is called, which begins by deleting what the
stages before it have left in the shared folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import langid, mixing, quality, queries, similar
from turnstone.llm.common import Recorded, cut, drop_scratch

#: Words of a block of the mix: documents are cut only where the mix takes part of one.
MIX_BLOCK = 512


#: Rows of an Arrow batch: whole texts stand in them, on both sides of a worker's pipe. A stage sets this for its session; run() sets it back.
ARROW_ROWS, ARROW_SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: While a stage runs, a job's shuffle files go with the job, rather than when the driver happens to collect its garbage: no later job reads them.
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The scratch tables of the stages that a run has called so far, each with the stage's place; stages called outside of run() share the default list.
_left: contextvars.ContextVar[list[tuple[int, Recorded]]] = contextvars.ContextVar("left", default=[])


@contextlib.contextmanager
def _tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_SETTING, "false")
    spark.conf.set(SHUFFLE_SETTING, True)
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_SETTING, before)


def _tidy(place: int, last: bool = False) -> Callable:
    """For a stage that drops what those before it left (but what its docs are read from), and leaves its own to a later one."""

    def tidy(stage: Callable) -> Callable:
        @functools.wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = _left.get()
            for k, other in [x for x in left if x[0] < place]:
                other.drop_but(docs)
                left.remove((k, other))
            spark.conf.set(ARROW_SETTING, ARROW_ROWS)
            with _tidy_shuffles(spark), Recorded() as own:
                found = stage(spark, docs, sf_dir)
            if not last:
                left.append((place, own))
            return found

        return run_stage

    return tidy


@_tidy(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base or that the voting rules find bad."""
    return quality.keep_good(docs)


@_tidy(2)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or no language that leads clearly."""
    return langid.keep_identified(docs)


@_tidy(3)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that 5-word shingles with a Jaccard similarity of 0.8 or more link.

    Pairs are found by SimHash with pigeonring filtering and by rare shingles, and verified by their texts.
    """
    return similar.keep_one(docs)


@_tidy(4)
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or the parts of them, as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, block=MIX_BLOCK)


@_tidy(5, last=True)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 4096 tokens."""
    return queries.packed(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: The stages learn models, tokenize and hash in ways that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, the stages applied in order to the documents table. Runs in several threads don't touch each other's tables."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    before, run_ = spark.conf.get(ARROW_SETTING), _left.set([])
    try:
        with _tidy_shuffles(spark):
            for _, stage in STAGES[:-1]:
                docs = cut(stage(spark, docs, sf_dir))
                if read is not None:
                    drop_scratch(read)
                read = docs
            return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        spark.conf.set(ARROW_SETTING, before)
        _left.reset(run_)
