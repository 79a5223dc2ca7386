"""Conversation logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnstone.sources.lines import RANGE_BYTES, LinesSource, line_status


def new_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The lines of files as they appear in a folder, with the time of their last change; a file that grows later isn't read again."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    told = lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return told.withColumn("status", line_status(F.col("value")))


def _numbered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The lines of a file that a batch has, numbered on from those before, whose number is the state."""
    rows = pd.concat(list(parts)).sort_values("byte_offset")
    before = state.get[0] if state.exists else 0
    state.update((before + len(rows),))
    yield rows.assign(line_no=range(before, before + len(rows)))[["source_file", "line_no", "byte_offset", "value"]]


def growing_files(spark: SparkSession, path: str, batch_bytes: int | None = None, progress: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of files in a folder as they are appended, each once, with number and offset.

    A line comes once its line end is there. With batch_bytes (and progress, a folder of the stream's
    own, beside its checkpoint), a backlog is taken in batches of about so many bytes; else at once. Files
    are numbered by keyed state, the count of each one's lines: so the lines of one file in one batch
    are one task's work, bounded by batch_bytes, and neither the driver nor a restart reads a file again.
    """
    spark.dataSource.register(LinesSource)
    limits = {} if batch_bytes is None else {"limit": batch_bytes, "progress": progress}
    rows = spark.readStream.format("lines").options(path=path, range_bytes=range_bytes, tasks=spark.sparkContext.defaultParallelism, **limits).load()
    numbered = rows.select("source_file", "byte_offset", "value").groupBy("source_file").applyInPandasWithState(
        _numbered, "source_file string, line_no bigint, byte_offset bigint, value string", "lines bigint", "append", GroupStateTimeout.NoTimeout
    )
    return numbered.withColumn("status", line_status(F.col("value")))


def drained(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Append all that is there now to the Parquet folder sink; a rerun goes on from the checkpoint."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def caught_up(rows: DataFrame, sink: str, checkpoint: str) -> list[int]:
    """drained() for sources that bound their batches: batches go on until nothing new is left. How many rows each has had."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(sink)
    try:
        query.processAllAvailable()
        return [p.numInputRows for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()


def once(rows: DataFrame, sink: str, checkpoint: str, keys: list[str], seen_at: str = "modified", within: str = "7 days") -> None:
    """Append all that is there now to the folder sink, each row (by its keys) once; rerun to go on.

    A batch that is replayed after a failure overwrites what it had written, as its folder has its number,
    and counts only once its commit record is there. What a renamed or copied file brings again is dropped by state, which
    is kept until the watermark, `within` behind the latest time of the column seen_at, has passed it.
    """
    fresh = rows.withWatermark(seen_at, within).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        batch.sparkSession.range(number, number + 1).toDF("batch").coalesce(1).write.mode("overwrite").parquet(f"{sink}/commits/batch_{number}")

    fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of the batches of once() that were committed."""
    commits = spark.read.parquet(f"{sink}/commits/*")
    return spark.read.option("basePath", f"{sink}/rows").parquet(f"{sink}/rows/*").join(F.broadcast(commits.distinct()), "batch", "left_semi").drop("batch")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window, in the type of their timestamps; state for windows older than `late` is dropped."""
    kind = events.schema["ts"].dataType
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast(kind).alias("began"), "event_type", "n")
