"""Profiles of nested records: every path at every depth, with what stands there and in which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.plans.scratch import cut

#: A key that stands in a path as it is; others are quoted.
PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"


def kind_of(value: Column) -> Column:
    """What a variant is: number, string, boolean, null, array or object."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def path_profile(records: DataFrame, body: str, file_col: str = "source_file") -> DataFrame:
    """A row (path, kind, n, first_file, last_file) for each path of the JSON text column body and kind of value there.

    The root is $, a key .key (or ."odd key"), an array's elements []. Records are unfolded level by level: what is an object or array
    goes on to the next one, as many levels as the deepest record has; scalars are counted and left behind. Each
    level's counts are small, and merge. Texts that are no JSON, and nulls, aren't counted.
    """
    parsed = F.try_parse_json(F.col(body))
    front = records.select(F.lit("$").alias("path"), F.col(file_col).alias("file"), parsed.alias("v")).where("v IS NOT NULL")
    counted = None
    while True:
        front = cut(front.withColumn("kind", kind_of(F.col("v"))))
        level = front.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))
        counted = level if counted is None else counted.unionByName(level)
        nested = front.where("kind IN ('array', 'object')")
        if nested.isEmpty():
            return counted.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min("first_file").alias("first_file"), F.max("last_file").alias("last_file"))
        named = nested.withColumnsRenamed({"path": "_path", "file": "_file", "kind": "_kind", "v": "_v"})
        unfolded = named.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        key = F.when(F.col("key").rlike(PLAIN_KEY), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("."), F.to_json(F.struct("key")).substr(F.lit(8), F.length(F.to_json(F.struct("key"))) - 8)))
        step = F.when(F.col("_kind") == "array", "[]").otherwise(key)
        front = unfolded.select(F.concat("_path", step).alias("path"), F.col("_file").alias("file"), F.col("value").alias("v"))
