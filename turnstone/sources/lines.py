"""Line-delimited files, line by line, with line numbers and byte offsets."""

from __future__ import annotations

import bisect
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from turnstone.plans.scratch import cut, scratch_dir

LINE = "source_file string, range_begin bigint, line_no bigint, byte_offset bigint, value string"
COUNT = "source_file string, range_begin bigint, n bigint"
#: A file is read in ranges of about so many bytes, and ranges of smaller files are packed into tasks up to as many.
RANGE_BYTES = 64 << 20
#: Opening a file costs as much as reading so many bytes.
OPEN_BYTES = 64 << 10
#: Bytes that a compressed one stands for.
UNPACKED = 4
#: From so many folders on, executors list them.
WIDE = 64
#: The table of ranges is broadcast if it has at most so many rows.
BROADCAST_ROWS = 200_000
BOM = b"\xef\xbb\xbf"
#: Lines, and bytes of them, that are handed on together.
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20
#: Bytes that are looked through at a time.
CHUNK = 1 << 20
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4", ".br": "brotli"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS or an object store), and the path there."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def codec(path: str) -> str | None:
    """How a file is compressed, by the end of its name."""
    return next((c for end, c in CODECS.items() if path.endswith(end)), None)


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def listed(path: str) -> list[pafs.FileInfo]:
    """The file at a path, or those in the folder there and in its folders, by path; hidden ones are left out."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    seen = lambda x: not any(map(_hidden, x.path[len(root.rstrip("/")) + 1 :].split("/")))
    return sorted((x for x in found if x.is_file and (x is info or seen(x))), key=lambda x: x.path)


def listing(spark: SparkSession, path: str, wide: int = WIDE) -> DataFrame:
    """listed() as a table (path, size). Once a level has `wide` folders or more, each is listed by an executor."""
    fs, root = opened(path)
    info = fs.get_file_info(root)
    files, level = [(info.path, info.size)] * info.is_file, [] if info.is_file else [root]
    while level and len(level) < wide:
        found = [x for folder in level for x in fs.get_file_info(pafs.FileSelector(folder)) if not _hidden(x.base_name)]
        files += [(x.path, x.size) for x in found if x.is_file]
        level = [x.path for x in found if x.type == pafs.FileType.Directory]

    def told(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int64())})

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for batch in batches:
            rows: list[tuple[str, int]] = []
            for folder in batch.column(0).to_pylist():
                left = [folder]
                while left:
                    found = [x for x in fs.get_file_info(pafs.FileSelector(left.pop())) if not _hidden(x.base_name)]
                    rows += [(x.path, x.size) for x in found if x.is_file]
                    left += [x.path for x in found if x.type == pafs.FileType.Directory]
                    if len(rows) >= BATCH_LINES:
                        yield told(rows)
                        rows = []
            yield told(rows)

    here = spark.createDataFrame(files, "path string, size bigint")
    if not level:
        return here
    folders = spark.createDataFrame([(x,) for x in level], "folder string").repartition(min(len(level), 4 * spark.sparkContext.defaultParallelism))
    return here.unionByName(folders.mapInArrow(below, "path string, size bigint"))


@dataclass
class Span:
    """The lines of a file that start (in a stream: end) at bytes begin .. end - 1 (to its end if None)."""

    path: str
    begin: int = 0
    end: int | None = None


@dataclass
class Spans(InputPartition):
    """What one task reads."""

    spans: list[Span]


def packed(spans: list[tuple[Span, int]], most: int, tasks: int) -> list[Spans]:
    """Spans with their bytes, put into tasks by best fit, the largest first.

    A task takes up to an equal share of all bytes, counting what opening a file costs, but no more than `most`: so many
    small files make about `tasks` tasks, and a large range has one of its own.
    """
    cost = [(n + OPEN_BYTES, k) for k, (_, n) in enumerate(spans)]
    room = min(most, max(OPEN_BYTES, -(-sum(n for n, _ in cost) // max(1, tasks)))) + OPEN_BYTES
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # what is left of each bin, sorted
    for n, k in sorted(cost, key=lambda x: (-x[0], x[1])):
        at = bisect.bisect_left(free, (n, -1))
        left, b = free.pop(at) if at < len(free) else (max(room, n), len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
        bisect.insort(free, (left - n, b))
    return [Spans([spans[k][0] for k in sorted(own)]) for own in bins]


def ranges(begin: int, end: int, most: int) -> list[tuple[int, int]]:
    """The bytes begin .. end - 1 in ranges of about `most`."""
    return [(k, min(k + most, end)) for k in range(begin, end, most)]


Row = tuple[str, int, int, int, str]


def batches_of(rows: Iterable[tuple[Row, int]]) -> Iterator[pa.RecordBatch]:
    """Rows with their bytes, in batches of bounded size, whatever files they are from."""
    names = [x.split()[0] for x in LINE.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names)
    own, held = [], 0
    for row, n in rows:
        own.append(row)
        held += n
        if len(own) >= BATCH_LINES or held >= BATCH_BYTES:
            yield batch()
            own, held = [], 0
    if own:
        yield batch()


def _row(span: Span, number: int, at: int, raw: bytes) -> tuple[Row, int]:
    text = raw.removesuffix(b"\n").removesuffix(b"\r")
    text = text.removeprefix(BOM) if at == 0 else text
    return (span.path, span.begin, number, at, text.decode("utf-8", "replace")), len(raw)


def started(fs: pafs.FileSystem, span: Span) -> Iterator[tuple[Row, int]]:
    """The lines that start in a span, numbered within it. A byte-order mark, the \\n and a \\r before it are no part of a line.

    Compressed files are read whole; offsets are those of what they hold.
    """
    number, at = 0, span.begin
    with fs.open_input_stream(span.path, compression=codec(span.path)) if codec(span.path) else fs.open_input_file(span.path) as file:
        if at:
            file.seek(at - 1)
        buffered = io.BufferedReader(file)
        if at:  # what is left of the line before, which is its line end alone if a line starts here
            at += len(buffered.readline()) - 1
        while (span.end is None or at < span.end) and (raw := buffered.readline()):
            yield _row(span, number, at, raw)
            at, number = at + len(raw), number + 1


def ended(fs: pafs.FileSystem, span: Span) -> Iterator[tuple[Row, int]]:
    """The lines whose line ends lie in a span, from where they start, which may be before it."""
    with fs.open_input_file(span.path) as file:
        at = span.begin
        while at:  # back to the line's start
            begin = max(0, at - CHUNK)
            file.seek(begin)
            if (found := file.read(at - begin).rfind(b"\n")) >= 0:
                at = begin + found + 1
                break
            at = begin
        file.seek(at)
        buffered, number = io.BufferedReader(file), 0
        while at < span.end and (raw := buffered.readline(span.end - at)).endswith(b"\n"):
            yield _row(span, number, at, raw)
            at, number = at + len(raw), number + 1


def count_started(fs: pafs.FileSystem, span: Span) -> int:
    """How many lines start in a span: one after each line end (and at the file's start), if any byte follows."""
    with fs.open_input_file(span.path) as file:
        end, at = min(span.end if span.end is not None else file.size(), file.size()), max(0, span.begin - 1)
        found = int(span.begin == 0 and file.size() > 0)
        file.seek(at)
        while at < end - 1 and (chunk := file.read(min(CHUNK, end - 1 - at))):
            found, at = found + chunk.count(b"\n"), at + len(chunk)
    return found


class LinesReader(DataSourceReader):
    """Ranges of files, packed into tasks; lines are numbered within a range. With count, a row for each range of a file that has several: how many lines start there."""

    def __init__(self, path: str, most: int = RANGE_BYTES, tasks: int = 8, manifest: str | None = None, count: bool = False):
        self.path, self.most, self.tasks, self.manifest, self.count = path, most, tasks, manifest, count

    def _files(self) -> list[tuple[str, int]]:
        if self.manifest is None:
            return [(x.path, x.size) for x in listed(self.path)]
        fs, root = opened(self.manifest)
        found = pq.read_table(root, filesystem=fs)
        return sorted(zip(found["path"].to_pylist(), found["size"].to_pylist()))

    def partitions(self) -> list[Spans]:
        spans = []
        for path, size in self._files():
            if codec(path):
                spans += [(Span(path), size * UNPACKED)] * (not self.count)
            elif size > self.most or not self.count:
                spans += [(Span(path, b, e if e < size else None), e - b) for b, e in ranges(0, size, self.most)]
        return packed(spans, self.most, self.tasks) or [Spans([])]

    def read(self, partition: Spans):
        fs, _ = opened(self.path)
        if self.count:
            return iter([(x.path, x.begin, count_started(fs, x)) for x in partition.spans])
        return batches_of(row for span in partition.spans for row in started(fs, span))


class GrowingReader(DataSourceStreamReader):
    """Follows files that grow: an offset holds, per file, the bytes that were taken. No file is opened in order to plan.

    A line belongs to the batch in whose bytes it ends; what stands after the last line end waits.
    Bytes that were read are taken not to change, and compressed files are left out. With limit,
    a batch takes about so many bytes, shared out evenly among the files that have more. As Spark doesn't say
    after a restart how far a stream had come, the planned ends are then noted in the folder
    progress: a batch is planned only once Spark has noted its end, too, and is planned
    again after a failure, so the two always agree when a further batch is asked for.
    """

    def __init__(self, path: str, most: int = RANGE_BYTES, tasks: int = 8, limit: int | None = None, progress: str | None = None):
        if limit is not None and progress is None:
            raise ValueError("a limit for each batch needs a folder for the progress")
        self.path, self.most, self.tasks, self.limit, self.progress, self.last = path, most, tasks, limit, progress, None

    def initialOffset(self) -> dict:
        return {}

    def _notes(self, fs: pafs.FileSystem, root: str) -> list[int]:
        return sorted(int(x.base_name) for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.isdigit())

    def _noted(self) -> dict:
        fs, root = opened(self.progress)
        if not (known := self._notes(fs, root)):
            return {}
        with fs.open_input_stream(f"{root}/{known[-1]}") as file:
            return json.loads(file.read())

    def _note(self, end: dict) -> None:
        fs, root = opened(self.progress)
        fs.create_dir(root)
        known, new = self._notes(fs, root), f"{root}/new-{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as file:
            file.write(json.dumps(end).encode())
        fs.move(new, f"{root}/{known[-1] + 1 if known else 0}")
        for k in known[:-1]:
            fs.delete_file(f"{root}/{k}")

    def latestOffset(self) -> dict:
        sizes = {x.path: x.size for x in listed(self.path) if not codec(x.path)}
        if self.limit is None:
            return sizes
        if self.last is None:
            self.last = self._noted()
        more = sorted((n - self.last.get(p, 0), p) for p, n in sizes.items() if n > self.last.get(p, 0))
        left, now = self.limit, dict(self.last)
        for k, (n, path) in enumerate(more):
            take = min(n, max(1, left // (len(more) - k)))
            now[path], left = now.get(path, 0) + take, left - take
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        if any(end.get(p, 0) < n for p, n in start.items()):
            raise ValueError(f"{self.progress} is behind the stream's checkpoint, or a file has become shorter")
        if self.limit is not None:
            self.last = end
            self._note(end)
        spans = [(Span(p, b, e), e - b) for p, upto in sorted(end.items()) for b, e in ranges(start.get(p, 0), upto, self.most)]
        return packed(spans, self.most, self.tasks)

    def read(self, partition: Spans):
        fs, _ = opened(self.path)
        return batches_of(row for span in partition.spans for row in ended(fs, span))


class LinesSource(DataSource):
    """format("lines"): lines of files, in batch or as a stream that follows growing files.

    line_no counts within the range that starts at range_begin. Options: range_bytes; tasks, about how many
    many small files make; manifest, a Parquet folder (path, size) of the files to read instead of a
    listing; count=true: the lines of each range are counted instead. Of a stream: limit, bytes of a batch, with progress, a folder.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def _counts(self) -> bool:
        return str(self.options.get("count", "false")).lower() == "true"

    def _shape(self) -> tuple[str, int, int]:
        return self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tasks", 8))

    def schema(self) -> str:
        return COUNT if self._counts() else LINE

    def reader(self, schema: StructType) -> DataSourceReader:
        return LinesReader(*self._shape(), self.options.get("manifest"), self._counts())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        limit = self.options.get("limit")
        return GrowingReader(*self._shape(), None if limit is None else int(limit), self.options.get("progress"))


def write_files(rows: DataFrame, path: str, folder: str, order: list[str], value: str = "value", compression: str = "gz") -> int:
    """Write a compressed file for each value of the column `folder`, path/folder=.../part.txt.gz, with the values as lines in that order (null: an empty line); how many.

    For very many small files: a task writes its own straight to where they belong, under a hidden name until they
    are complete, so nothing is left to move one by one at the end, and an attempt that is run again overwrites its own.
    """
    end = f".{compression}"
    kind = CODECS[end]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        file, last, n, names = None, None, 0, []

        def close() -> None:
            file.close()
            fs.move(names[0], names[1])

        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None or own != last:
                    if file is not None:
                        close()
                    parent = f"{root}/{folder}={own}"
                    fs.create_dir(parent)
                    names, last, n = [f"{parent}/.{uuid.uuid4().hex}{end}", f"{parent}/part.txt{end}"], own, n + 1
                    file = fs.open_output_stream(names[0], compression=kind)
                file.write((line or "").encode() + b"\n")
        if file is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    parted = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, folder).sortWithinPartitions(folder, *order)
    return parted.select(folder, value).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def line_status(value: Column) -> Column:
    """ok, blank (nothing but white space), malformed, duplicate_key or non_object; null for no line.

    A line with a key twice in one object is no variant, but still has a first value
    for get_json_object.
    """
    parsed = F.try_parse_json(value)
    return (
        F.when(value.isNull(), None)
        .when(~value.rlike(r"\S"), "blank")
        .when(parsed.isNull() & F.get_json_object(value, "$").isNotNull(), "duplicate_key")
        .when(parsed.isNull(), "malformed")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "non_object")
        .otherwise("ok")
    )


def stored_files(spark: SparkSession, store: str) -> DataFrame | None:
    """The source files (source_file) that a Parquet folder has rows of; None if there is no such folder."""
    fs, root = opened(store)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return None
    return spark.read.parquet(store).select("source_file").distinct()


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, files: DataFrame | None = None) -> DataFrame:
    """A row (source_file, line_no, byte_offset, value, status) per line, blank and broken ones too.

    Line numbers count from 0 in each file. Files are read in ranges of about range_bytes; small ones are packed into tasks,
    about as many as the session has cores, and wide trees are listed by executors. If
    a file has several ranges, a pass before counts the lines of each of its ranges, and prefix sums
    number them. Files whose names say that they are compressed (.gz, .bz2, .zst, .lz4, .br) are unpacked, each by one task. With
    files, some rows of listing(), only those are read. An empty folder gives no rows.
    """
    spark.dataSource.register(LinesSource)
    chosen = scratch_dir(spark)
    # not coalesced, as one task would then list the whole tree
    (listing(spark, path) if files is None else files.select("path", "size")).write.parquet(chosen)
    options = {"range_bytes": range_bytes, "tasks": spark.sparkContext.defaultParallelism, "manifest": chosen}
    read = lambda **more: spark.read.format("lines").options(**options, **more).load(path)
    rows, number = read(), F.col("line_no")
    large = F.max(F.when(~F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in CODECS) + ")$"), F.col("size")))
    if (spark.read.parquet(chosen).agg(large).first()[0] or 0) > range_bytes:
        upto = W.partitionBy("source_file").orderBy("range_begin").rowsBetween(W.unboundedPreceding, -1)
        counted = cut(read(count="true").select("source_file", "range_begin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
        small = counted.count() <= BROADCAST_ROWS
        rows, number = rows.join(F.broadcast(counted) if small else counted, ["source_file", "range_begin"], "left"), number + F.coalesce("before", F.lit(0))
    return rows.select("source_file", number.alias("line_no"), "byte_offset", "value", line_status(F.col("value")).alias("status"))


def locate(lines: DataFrame, source_file: str, line_no: int) -> DataFrame:
    """The line of that number in the files of that path, whole or from one of its folders on (b.jsonl isn't ab.jsonl)."""
    named = (F.col("source_file") == source_file) | F.col("source_file").endswith("/" + source_file.lstrip("/"))
    return lines.where((F.col("line_no") == line_no) & named)
