"""Defined results of inspections and timelines on nulls, ties, repeats and empty tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as texts
from turnstone.operators import inspecting, timeline
from turnstone.plans import scratch
from turnstone.plans.scratch import cut, drop_scratch

TURNS = "conv_id bigint, turn bigint, role string, text string"
ROWS = [(1, 0, "user", "Hi there"), (1, 1, "assistant", None), (1, 3, "user", "ÜBER thing"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 5, None, "lost")]


def turns(spark, rows=ROWS):
    return spark.createDataFrame(rows, TURNS)


def test_outline_and_gaps(spark):
    got = {(r.conv_id, r.turn, r.running_chars) for r in timeline.outline(turns(spark)).collect()}
    assert (1, 1, 8) in got and (1, 3, 18) in got and (None, 5, 4) in got
    assert [(r.conv_id, r.turn, r.prev_turn, r.missing) for r in timeline.gaps(turns(spark)).collect()] == [(1, 3, 1, 1)]
    assert timeline.outline(turns(spark, [])).count() == 0


def test_summary_of_nulls(spark):
    got = {r.conv_id: (r.n_turns, r.chars, r.longest, r.user_turns) for r in inspecting.summary(turns(spark)).collect()}
    assert got == {1: (3, 18, 10, 2), 2: (2, 0, 0, 2), None: (1, 4, 4, 0)}


def test_search(spark):
    assert [r.snippet for r in inspecting.search(turns(spark), "THING", around=2).collect()] == ["R thing"]
    assert [r.turn for r in inspecting.search(turns(spark), "über").collect()] == [3]
    assert inspecting.search(turns(spark), "absent").count() == 0


def test_longest_breaks_ties_by_turn(spark):
    rows = [(1, 0, "u", "aa"), (1, 1, "u", "bb"), (1, 2, "u", "c")]
    assert sorted((r.rank, r.turn) for r in inspecting.longest(turns(spark, rows), 2).collect()) == [(1, 0), (2, 1)]


def test_duplicates_of_null_text_are_one_group(spark):
    rows = [(1, 0, "u", None), (2, 0, "u", None), (3, 0, "u", "x")]
    assert [(r.digest, r.n) for r in inspecting.duplicates(turns(spark, rows)).collect()] == [(None, 2)]


def test_value_types(spark):
    bodies = ['{"k":1}', '{"k":"s"}', '{"k":true}', '{"k":null}', '{"k":[1]}', '{"k":{}}', "{}", "broken", None, '{"k":1.5}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r.kind: r.n for r in inspecting.value_types(df, "body", "$.k").collect()} == {"number": 2, "string": 1, "boolean": 1, "null": 1, "array": 1, "object": 1, "absent": 3}
    assert {r.key: r.n for r in inspecting.key_inventory(df, "body").collect()} == {"k": 7}


def test_unfolded(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[2]}'), (2, "[3,null]"), (3, "7"), (4, None)], "k int, body string")
    got = {(r.k, r.pos, r.name, r.json) for r in inspecting.unfolded(df, "k", "body").collect()}
    assert got == {(1, 0, "a", "1"), (1, 1, "b", "[2]"), (2, 0, None, "3"), (2, 1, None, "null")}


def test_sessions_close_after_the_gap(spark):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    df = spark.createDataFrame([(1, at(0)), (1, at(30)), (1, at(61)), (2, at(5))], "user_id int, ts timestamp_ntz")
    assert sorted((r.user_id, r.began, r.n) for r in timeline.sessions(df, "30 minutes").collect()) == [(1, at(0), 2), (1, at(61), 1), (2, at(5), 1)]


def test_text_counts(spark):
    df = spark.createDataFrame([("a b\n c",), ("",), (None,)], "t string")
    assert [tuple(r) for r in df.select(texts.n_words(F.col("t")), texts.n_lines(F.col("t"))).collect()] == [(3, 2), (0, 1), (None, None)]
    (one,) = spark.range(1).select(texts.pretty(F.parse_json(F.lit('{"b":1,"a":"x"}'))).alias("p")).collect()
    assert one.p == '{"a":"x","b":1}'


def test_cut_and_drop(spark):
    df = cut(spark.range(10), rows=10)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 10
    files = df.inputFiles()
    drop_scratch(df)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_a_cluster_has_to_name_its_shared_folder():
    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder} if folder else {}, self
            self.master, self.getConf = master, lambda: {}

    for master in ("local", "local[*]", "local[8]"):
        assert scratch.scratch_dir(Session(master, None)).startswith(f"{scratch.LOCAL_CHECKPOINTS}/turnstone-")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="cluster shares"):
            scratch.scratch_dir(Session(master, None))
        assert scratch.scratch_dir(Session(master, "hdfs://host/tmp/")).startswith("hdfs://host/tmp/turnstone-")


def test_recorded_scratch_tables_go_unless_they_are_read(spark):
    with scratch.Recorded() as own:
        one, two = cut(spark.range(3)), cut(spark.range(4))
    other = cut(spark.range(5))
    own.drop_but(two.where("id > 1"))
    assert two.count() == 4 and other.count() == 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in one.inputFiles())
    own.drop_but(other)
    assert other.count() == 5 and not any(os.path.exists(f.removeprefix("file://")) for f in two.inputFiles())
