"""Archives against a plain account of records, other writers' files, push-down and broken files."""

import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnstone.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, first string, target_uri int"
LONG = "<html>" + "é long page " * 100
ROWS = [(1, "http://a/1", LONG), (5, "http://a/5", LONG), (3, None, LONG), (7, "http://b/7", "short"), (8, "http://b/8", "short"), (9, "http://c/\r\nX: y", None), (10, "", ""), (11, "u", LONG + "other"), (12, "u", "x" * 3_000_000), (13, "v", "x" * 3_000_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def want(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, u, h in rows:
        body = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        again = len(body) >= 1000 and ids and i != max(ids)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip(spark):
    got = warc.round_trip(table(spark, ROWS))
    assert found(got) == want(ROWS)
    urls = {r.page_id: r.url for r in got.collect()}
    assert urls == {i: u for i, u, _ in ROWS}  # with line ends, white space and all


def test_every_url_comes_back(spark):
    rows = [(k, u, "x") for k, u in enumerate(["", " ", " http://a/ b ", "http://a/%0A%20", "\x00\x1f\x7f\x85", "é中 €", "a\tb", None, "x: y\r\n\r\nWARC/1.1", "%", "\ufeffu"])]
    assert {r.page_id: r.url for r in warc.round_trip(table(spark, rows)).collect()} == {k: u for k, u, _ in rows}


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", LONG), (None, "u", LONG), (4, "u", LONG), (4, "u", LONG), (None, "w", LONG + "!"), (None, "w", LONG + "!")]
    assert found(warc.round_trip(table(spark, rows))) == want(rows)


def test_empty(spark):
    assert warc.round_trip(table(spark, [])).count() == 0


def test_a_large_group_of_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(LONG).alias("html"))
    got = warc.round_trip(rows).groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got), key=repr) == [("response", None, 1), ("revisit", 2999, 2999)]


@pytest.mark.parametrize("compress", [True, False])
def test_payloads_and_push_down(spark, tmp_path, compress):
    warc.register(spark)
    path = str(tmp_path / "w")
    rows = [(f"<r:{k}>", "response" if k % 3 else "revisit", f"http://h/{k % 2}", None, hashlib.sha1(f"päge {k}".encode()).hexdigest(), len(f"päge {k}".encode()), f"päge {k}".encode(), None, None) for k in range(60)]
    spark.createDataFrame(rows, warc.RECORD).write.format("warc").option("compress", compress).mode("append").save(path)
    df = spark.read.format("warc").load(path)
    assert {(r.record_id, r.payload) for r in df.collect()} == {(r[0], r[6] if r[1] == "response" else None) for r in rows}
    some = df.where((F.col("record_type") == "response") & F.col("target_uri").isin("http://h/1", "http://no") & F.col("payload").cast("string").contains("1"))
    assert {r.record_id for r in some.collect()} == {r[0] for r in rows if r[1] == "response" and r[2] == "http://h/1" and b"1" in r[6]}
    assert df.where("record_type IS NULL").count() == 0
    assert df.where("refers_to IS NOT NULL").count() == 0
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload IS NOT NULL").count() == 0
    spark.createDataFrame(rows[:2], warc.RECORD).write.format("warc").option("compress", compress).mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 62


def record(kind, body, **headers):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_unwanted_payloads_are_not_decoded():
    good = record("response", b"HTTP/1.1 200 OK\r\n\r\nhello", WARC_Record_ID="<1>")
    raw = record("warcinfo", b"\xff\xfe not text") + record("request", b"GET /") + good
    rows = list(warc.read_records(io.BufferedReader(io.BytesIO(raw)), lambda row: row["record_type"] == "response"))
    assert [(r["record_id"], r["payload"], r["payload_bytes"]) for r in rows] == [("<1>", b"hello", 5)]


def test_archives_of_other_writers(spark, tmp_path):
    warc.register(spark)
    parts = [record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\none\r\n\r\ntwo", warc_record_id="<1>"), record("response", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Record_ID="<2>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = spark.read.format("warc").load(str(tmp_path)).select("record_id", "payload").collect()
    assert sorted(map(tuple, got)) == [("<1>", b"one\r\n\r\ntwo")] * 2 + [("<2>", b"")] * 2
    assert spark.read.format("warc").load(str(tmp_path / "b.warc")).count() == 2


def test_other_types_and_digests(spark, tmp_path):
    warc.register(spark)
    parts = [
        record("resource", "née".encode(), WARC_Record_ID="<1>", Content_Type="text/plain", WARC_Payload_Digest="md5:abc"),
        record("conversion", b"a\r\n\r\nb", WARC_Record_ID="<2>", Content_Type="text/plain", WARC_Payload_Digest="sha1:" + "AB" * 20),
        record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello \xff", WARC_Record_ID="<3>", Content_Type="application/http; msgtype=response"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Record_ID="<4>", Content_Type="application/http"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(str(tmp_path)).orderBy("record_id")
    assert [(r.payload, r.payload_bytes, r.payload_digest) for r in read("true").collect()] == [("née".encode(), 4, "md5:abc"), (b"a\r\n\r\nb", 6, "ab" * 20), (b"hello \xff", 7, None), (None, None, None)]
    for payload in ("false", "check"):
        assert [(r.payload, r.payload_bytes) for r in read(payload).collect()] == [(None, 4), (None, 6), (None, 7), (None, None)]
    assert {r.record_id for r in read("false").where("payload_bytes > 4").collect()} == {"<2>", "<3>"}


def test_foreign_files_beside_those_of_this_writer(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "theirs.warc").write_bytes(record("response", b"HTTP/1.1 200 OK\r\n\r\none", WARC_Record_ID="<theirs>"))
    (tmp_path / f"{warc.PREFIX}of-an-attempt-that-did-not-end.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resp")
    rows = [(f"<{k}>", "resource", None, None, None, None, str(k).encode(), None, None) for k in range(3)]
    mine = spark.createDataFrame(rows, warc.RECORD)
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(str(tmp_path)).collect())
    mine.write.format("warc").mode("append").save(str(tmp_path))
    assert ids() == ["<0>", "<1>", "<2>", "<theirs>"]
    mine.write.format("warc").mode("append").save(str(tmp_path))
    assert len(ids()) == 7
    mine.where("record_id = '<1>'").write.format("warc").mode("overwrite").save(str(tmp_path))
    assert ids() == ["<1>"]


def test_predicates_reach_the_source(spark):
    plan = warc.round_trip(table(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "Filter (record_type" not in plan


@pytest.mark.parametrize("wanted", [True, False])
@pytest.mark.parametrize("less", [1, 3, 4, 12])
def test_broken_archives_are_told(wanted, less):
    everything = lambda row: True
    cut_off = record("response", b"HTTP/1.1 200 OK\r\n\r\nhello")[:-less]
    for payloads in ("true", "check", "false"):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.read_records(io.BufferedReader(io.BytesIO(cut_off)), lambda row: wanted, payloads))
    with pytest.raises(ValueError, match="no record starts"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(b"<html>\r\n")), everything))
    changed = warc.record({"record_id": "<1>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": hashlib.sha1(b"a").hexdigest(), "payload_bytes": 1, "payload": b"b"}, False)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(changed)), everything))


def http(body, **headers):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body


def test_foreign_codings_and_charsets(spark, tmp_path):
    warc.register(spark)
    latin, meta = "<p>café</p>".encode("latin-1"), "<meta charset='iso-8859-1'><p>né</p>".encode("latin-1")
    bodies = [
        (http(latin, Content_Type="text/html; charset=ISO-8859-1"), latin, "<p>café</p>"),
        (http(gzip.compress("née".encode()), Content_Encoding="gzip"), gzip.compress("née".encode()), "née"),
        (http(zlib.compress(b"plain"), Content_Encoding="deflate"), zlib.compress(b"plain"), "plain"),
        (http(meta), meta, meta.decode("latin-1")),
        (http(b"\xff\xfe!"), b"\xff\xfe!", None),
        (http(b"not zipped", Content_Encoding="gzip"), b"not zipped", None),
        (http(b"odd", Content_Encoding="rot13"), b"odd", None),
        (http(b"odd charset", Content_Type="text/html; charset=no-such"), b"odd charset", "odd charset"),
    ]
    bodies[4] = (*bodies[4][:2], "\ufffd\ufffd!")
    (tmp_path / "a.warc").write_bytes(b"".join(record("response", b, WARC_Record_ID=f"<{k}>") for k, (b, _, _) in enumerate(bodies)))
    rows = spark.read.format("warc").load(str(tmp_path)).withColumn("text", warc.payload_text(F.col("payload"), F.col("content_encoding"), F.col("charset"))).orderBy("record_id").collect()
    assert [(r.payload, r.text) for r in rows] == [(p, t) for _, p, t in bodies]
    assert warc.decoded(None, None, None) is None


def test_records_without_a_length_are_told(spark, tmp_path):
    warc.register(spark)
    good = record("response", http(b"x"), WARC_Record_ID="<1>")
    (tmp_path / "a.warc").write_bytes(good + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n")
    with pytest.raises(Exception, match=rf"a\.warc: the record at byte {len(good)} "):
        spark.read.format("warc").load(str(tmp_path)).count()


def test_revisits_say_what_they_are():
    row = {"record_id": "<1>", "record_type": "revisit", "target_uri": "u", "refers_to": "<2>", "payload_digest": None, "payload_bytes": 3, "payload": None}
    assert b"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" in warc.record(row, False)
    assert b"WARC-Profile" not in warc.record(row | {"record_type": "response"}, False)
