"""Records out of JSON lines, typed reads, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines


def read_records(spark: SparkSession, path: str, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """A row per line with status ok: source_file, line_no, the mapped columns, and body (a variant).

    mapping: column name to (JSON path, Spark type). A value that doesn't cast is null.
    """
    return to_records(read_lines(spark, path), mapping)


def to_records(lines: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    parsed = lines.where("status = 'ok'").withColumn("body", F.try_parse_json("value"))
    return parsed.select("source_file", "line_no", *[F.try_variant_get("body", at, kind).alias(name) for name, (at, kind) in mapping.items()], "body")


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Spark's own JSON reader with a schema; _corrupt_record has the lines that don't fit it."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object per row and line; null fields are kept, so that columns come back."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Many files as one: columns by name, missing ones null."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
