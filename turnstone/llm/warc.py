"""WARC archives as a Spark data source, and pages archived with revisit records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from turnstone.sources.lines import opened

from .common import cut, join_counted, lean, scratch_dir

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, content_encoding string, charset string"
#: The header of each column; what has none is the payload's.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}
#: What a revisit record of an equal payload says it is.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Predicates on these are judged on the headers; payload_bytes may be known from the block alone.
JUDGED = frozenset(HEADERS) - {"payload_bytes"}
#: A target URI that a header can't hold as it is stands here, percent-encoded throughout.
WHOLE_URI = "X-Whole-Target-URI"
#: Files of this writer; one that no manifest lists is of a write that didn't end.
PREFIX = "turnstone-"
#: Written once all files of a write are whole; it lists them.
MANIFEST = "_FILES"
#: Payloads under this size are stored again rather than referred to.
REVISIT_BYTES = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A file is closed once it has so many bytes, so that reading can be spread.
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def _line(value: str) -> str:
    """What a header can hold of a value: control characters are percent-encoded, outer white space goes."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: quote(m[0]), value).strip()


def record(row: dict, compress: bool) -> bytes:
    """A record with RECORD's fields. A revisit just tells of its payload; all others hold theirs as it is, a response after an HTTP head that says it is UTF-8."""
    values = {HEADERS[k]: str(row[k]) for k in HEADERS if row[k] is not None}
    if row["payload_digest"] is not None:
        values["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    if row["target_uri"] is not None and _line(row["target_uri"]) != row["target_uri"]:
        values[WHOLE_URI] = quote(row["target_uri"], safe="")
    payload, kind = row["payload"] or b"", row["record_type"]
    if kind == "revisit":
        values["WARC-Profile"] = SAME_PAYLOAD
    block = HTTP if kind == "revisit" else HTTP + payload if kind == "response" else payload
    content = "application/http; msgtype=response" if kind in ("response", "revisit") else "application/octet-stream"
    head = [f"{name}: {_line(value)}" for name, value in values.items()]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    whole = b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, 1, mtime=0) if compress else whole


def _digest(value: str | None) -> str | None:
    """A SHA-1 digest in lower-case hex; another algorithm's as the header has it."""
    kind, _, digits = (value or "").partition(":")
    if kind.lower() == "sha1" and re.fullmatch(r"[A-Za-z2-7]{32}", digits):
        return base64.b32decode(digits.upper()).hex()
    return digits.lower() if kind.lower() == "sha1" else value


def _header(stream) -> tuple[dict[str, str], dict]:
    """The headers of the record that starts here, by lower-case name, and RECORD's fields that they tell."""
    named: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        named[name.strip().lower()] = value.strip()
    row: dict = {k: named.get(h.lower()) for k, h in HEADERS.items()}
    if (uri := named.get(WHOLE_URI.lower())) is not None:
        row["target_uri"] = unquote(uri)
    row["payload_digest"] = _digest(row["payload_digest"])
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    return named, row | {"payload": None, "content_encoding": None, "charset": None}


def _coded(head: bytes) -> dict[str, str | None]:
    """What an HTTP head says of its body: content_encoding and charset, in lower case."""
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")]
    named = {name.strip().lower(): value.strip().lower() for name, _, value in lines}
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""))
    return {"content_encoding": named.get("content-encoding") or None, "charset": charset[1] if charset else None}


#: How a page names its charset by itself.
_META = re.compile(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def decoded(payload: bytes | None, content_encoding: str | None, charset: str | None) -> str | None:
    """The text of a payload: its content codings (gzip, deflate, br, zstd) undone, the last one first, and its charset, or the one that the page names, or UTF-8, decoded.

    What doesn't decode stands as replacement characters; a payload whose codings are unknown, or that isn't coded as it
    says, gives None, as does none.
    """
    if payload is None:
        return None
    try:
        for coding in reversed([x.strip() for x in (content_encoding or "").split(",") if x.strip() not in ("", "identity")]):
            if coding == "deflate":
                payload = zlib.decompress(payload) if payload[:1] == b"\x78" else zlib.decompress(payload, -zlib.MAX_WBITS)
            else:
                kind = {"gzip": "gzip", "x-gzip": "gzip", "br": "brotli", "zstd": "zstd"}[coding]
                payload = pa.CompressedInputStream(pa.BufferReader(payload), kind).read()
    except (KeyError, OSError, zlib.error, pa.ArrowInvalid):
        return None
    found = _META.search(payload[:4096])
    for name in (charset, found and found[1].decode("ascii", "replace")):
        try:
            if name:
                return payload.decode(name, "replace")
        except LookupError:  # no such charset
            continue
    return payload.decode("utf-8", "replace")


def payload_text(payload: Column, content_encoding: Column, charset: Column) -> Column:
    """decoded() of columns."""

    @F.arrow_udf("string")
    @lean
    def run(payload: pa.Array, coding: pa.Array, charset: pa.Array) -> pa.Array:
        return pa.array([decoded(*(x.as_py() for x in row)) for row in zip(payload, coding, charset)], pa.string())

    return run(payload, content_encoding, charset)


def read_records(stream, wanted, payloads: str = "true") -> Iterator[dict]:
    """The records of an open archive for whose headers wanted() is true.

    The headers are read and judged first; the block of another record is passed over.
    payloads: "true" gives them as bytes, "check" just holds those of this writer's records
    against their digests, "false" passes them over, too. The payload is what follows
    the head of an HTTP message, of other records the whole block, and none of a revisit.
    An archive that ends within a record is an error, also where the record isn't wanted.
    """
    while True:
        at = stream.tell()
        if not (line := stream.readline()):
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"at byte {at} no record starts, but {line[:40]!r}")
        named, row = _header(stream)
        if not named.get("content-length", "").isdigit():
            raise ValueError(f"the record at byte {at} doesn't say how long it is")
        length, own, content = int(named["content-length"]), row["payload_bytes"] is not None, named.get("content-type", "").lower()
        http = "application/http" in content or not content and row["record_type"] in ("request", "response")
        take = wanted(row)
        held, head = row["record_type"] != "revisit", b""
        if take and held and (payloads != "false" or not own):
            if payloads == "false":  # its length alone
                while http and len(head) < length and (line := stream.readline(length - len(head))):
                    head += line
                    if not line.strip():
                        break
                row["payload_bytes"] = length - len(head)
                stream.seek(length - len(head), io.SEEK_CUR)
            else:
                block = stream.read(length)
                head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
                row |= _coded(head) if http else {}
                if len(block) == length and own and row["payload_digest"] and hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"{row['record_id']} doesn't have the digest in its header")
                row["payload_bytes"] = len(payload)
                if payloads == "true":
                    row["payload"] = payload
        else:
            stream.seek(length, io.SEEK_CUR)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']} at byte {at} is cut off")
        if take:
            yield row


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """Reads RECORD rows; a partition is an archive file.

    Comparisons of header columns with constants are pushed down and judged on the
    parsed headers; payload says what is done with payloads (read_records).
    """

    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in JUDGED and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)):
                self.tests.append((f.attribute[0], None if isinstance(f, IsNotNull) else tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [_File(root)]
        found = sorted((x for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file), key=lambda x: x.path)
        whole = set(_manifested(fs, found))
        kept = [x.path for x in found if not x.base_name.startswith((".", "_")) and (x.base_name in whole or not x.base_name.startswith(PREFIX))]
        return [_File(x) for x in kept] or [_File("")]

    def wanted(self, row: dict) -> bool:
        return all(row[k] is not None if values is None else row[k] in values for k, values in self.tests)

    def read(self, partition: _File):
        if not partition.path:  # an empty folder
            return
        fs, _ = opened(self.path)
        names, kinds, rows, held = [x.split()[0] for x in RECORD.split(", ")], {"payload_bytes": pa.int64(), "payload": pa.binary()}, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names})

        with fs.open_input_file(partition.path) as raw:
            gzipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            found = read_records(gzip.GzipFile(fileobj=raw) if gzipped else io.BufferedReader(raw), self.wanted, self.payload)
            while True:
                try:
                    row = next(found, None)
                except ValueError as e:
                    raise ValueError(f"{partition.path}: {e} (bytes of what it unpacks to)") from e
                if row is None:
                    break
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


def _manifested(fs: pafs.FileSystem, found: list[pafs.FileInfo]) -> list[str]:
    return [name for x in found if x.base_name.startswith(MANIFEST) for name in fs.open_input_stream(x.path).readall().decode().split("\n") if name]


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes RECORD rows. Files of attempts that didn't end are left out of the manifest.

    Overwriting takes all other archives out of the folder once the new ones are whole;
    until then a reader still finds the old ones.
    """

    def __init__(self, path: str, compress: bool, overwrite: bool = False):
        self.path, self.compress, self.overwrite = path, compress, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = opened(self.path)
        fs.create_dir(root)
        files, out = [], None
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    files.append(f"{PREFIX}{uuid.uuid4().hex}.warc{'.gz' * self.compress}")
                    out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                out.write(record(batch.slice(k, 1).to_pylist()[0], self.compress))
                if out.tell() > FILE_BYTES:
                    out = out.close()
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root)
        new, manifest = [f for m in messages if m for f in m.files], f"{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{manifest}") as out:
            out.write("\n".join([*new, ""]).encode())
        if self.overwrite:
            found = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name not in {*new, manifest}]
            for x in sorted(found, key=lambda x: not x.base_name.startswith(MANIFEST)):  # the manifests first, which hides the old files at once
                fs.delete_file(x.path)

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """format("warc"), with the options path, payload (true, the default; check; false) and compress (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], str(self.options.get("compress", "true")).lower() == "true", overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filter push-down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row of pages into the folder path.

    Of rows with equal payloads of at least `least` bytes, those with the largest id
    are responses and the others revisit records that refer to it; all smaller ones are
    responses. A null html has an empty payload. A null id counts as the least; if all
    ids of a group are null, all its rows are responses. Only digests of the
    payloads are grouped; the pages meet the groups' ids, of which each copied text
    has one. Repeated rows are records each, of one record id; an empty table writes no record; other columns
    are ignored, whatever their names. A payload has to fit into a task's memory, whole and
    compressed.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest")
    )
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    placed = join_counted(rows, cut(groups), "payload_digest")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    placed.select(
        name(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, name(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload").cast("binary")).alias("payload"),
        F.lit(None).cast("string").alias("content_encoding"),
        F.lit(None).cast("string").alias("charset"),
    ).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """A row (id, url, payload_bytes, payload_digest, record_type, refers_to) per page, read back from archives.

    Responses and revisits are read apart, by predicates that the source judges on the
    headers. A response's payload is read and held against its digest; what a revisit tells
    stands in its headers, so of that read no block is looked at.
    """
    spark = pages.sparkSession
    register(spark)
    path = scratch_dir(spark)
    archive(pages, path, id_col=id_col, **options)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(pages.schema[id_col].dataType)

    def read(kind: str, payload: str) -> DataFrame:
        return spark.read.format("warc").option("payload", payload).load(path).where(F.col("record_type") == kind)

    found = read("response", "check").unionByName(read("revisit", "false"))
    return found.select(number("record_id").alias(id_col), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
