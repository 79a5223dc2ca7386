"""Scratch tables in the folder that a cluster shares, where a plan's lineage is cut."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rows of a narrow scratch table that a file has at least, where their number is known.
FILE_ROWS = 250_000
#: Used only by local sessions that set no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name inside the shared checkpoint folder of the session.

    A cluster's session has to name that folder: what executors write to their own disks, others don't find.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    _written.append(f"{(root or LOCAL_CHECKPOINTS).rstrip('/')}/turnstone-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what is
    above, and the rows are computed once however often they are read. rows, where the
    caller knows a bound, keeps narrow tables from being spread over tiny files.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) or 1)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, rows: int | None = None, **what: Column) -> tuple[DataFrame, dict]:
    """cut(df), and what some aggregates over it are, taken while it is written rather than by another job."""
    seen = Observation()
    written = cut(df.observe(seen, *[c.alias(name) for name, c in what.items()]), rows)
    return written, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    _written.remove(path)


def _folders(df: DataFrame) -> set[str]:
    """The scratch folders whose files a table's plan reads."""
    names = {file.rpartition("/")[0].rpartition("/")[2] for file in df.inputFiles()}
    return {x for x in _written if x.rpartition("/")[2] in names}


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table that cut() returned and that no plan still needs."""
    for path in _folders(df):
        _delete(df.sparkSession, path)


class Recorded:
    """with Recorded() as r: the scratch folders that are written meanwhile. r.drop_but(df) deletes those that the plan of df doesn't read."""

    def __enter__(self) -> Recorded:
        self.before = set(_written)
        return self

    def __exit__(self, *_) -> None:
        self.folders = [x for x in _written if x not in self.before]

    def drop_but(self, df: DataFrame) -> None:
        needed = _folders(df)
        for path in [x for x in self.folders if x in _written and x not in needed]:
            _delete(df.sparkSession, path)
