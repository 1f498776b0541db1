"""Framed message files as a Spark data source: ``spark.read.format("framed")``, streams, and a sink.

Options: path (a file, folder or glob, on any file system that Arrow knows),
max_message (bytes), decode (false passes any framed bytes as raw), split (bytes
of a file per task), lookback (bytes). A task finds the frames that begin in its
range. It reads in windows and ahead of them only as far as a frame's header
tells, so it holds a window and a frame. Where frames begin is known from the
chain of those before: the scan starts ``lookback`` bytes before the range, or
the largest message, if that is less. A longer message over the edge of a range,
whose payload itself holds whole frames, needs a ``lookback`` of its size.
"""

from __future__ import annotations

import fnmatch
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rillet.schema import HEADERS, MESSAGE_DDL, VALUES, arrow_fields
from rillet.sources import codec, wire

SCAN_DDL = f"path string, offset bigint, discarded bigint, {MESSAGE_DDL}, raw binary"
WINDOW, LOOKBACK = 4 << 20, 1 << 20
#: Bytes of stored tables for each partition that codes messages, and the most partitions; sizes from UNKNOWN on are no sizes.
PART, MOST_PARTS, UNKNOWN = 2 << 20, 20_000, 1 << 50


def place(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what makes such a path a full one again; local paths need no scheme."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+://", path):
        base = re.match(r"([^*?\[]*)(.*)", path, re.S)
        system, root = fs.FileSystem.from_uri(base[1])
        return system, root + base[2], "" if path.startswith("file://") else base[1][: len(base[1]) - len(root.lstrip("/"))]
    return fs.LocalFileSystem(), path, ""


def files(path: str) -> dict[str, int]:
    """Sizes of the files that a path names, in the order of their names; hidden ones are left out."""
    system, root, scheme = place(path)
    if re.search(r"[*?\[]", root):
        above = re.match(r"[^*?\[]*/", root)
        found = system.get_file_info(fs.FileSelector(above[0].rstrip("/") or "/" if above else ".", recursive=True, allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.path, root) and f.path.count("/") == root.count("/")]
    else:
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return {scheme + info.path: info.size}
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return {scheme + f.path: f.size for f in sorted(shown, key=lambda f: f.path)}


def opened(path: str) -> pa.NativeFile:
    system, name, _ = place(path)
    return system.open_input_file(name)


@dataclass
class Range(InputPartition):
    """limit: where the file's known part ends; None is the whole file."""

    path: str
    begin: int
    end: int
    limit: int | None = None


def arrow_schema(*around: tuple[str, pa.DataType], after: tuple[tuple[str, pa.DataType], ...] = ()) -> pa.Schema:
    """The message's columns between others."""
    return pa.schema([*[pa.field(n, t) for n, t in around], *arrow_fields(), *[pa.field(n, t) for n, t in after]])


FRAME = (("offset", pa.int64()), ("discarded", pa.int64()))
RAW = (("raw", pa.binary()),)


def found(file: pa.NativeFile, begin: int, end: int, most: int, decoded: bool, limit: int | None = None) -> Iterator[tuple[int, int, dict]]:
    """offset, end and message of the frames of a file that begin in [begin, end), read up to ``limit``."""
    reader, at, size = codec.StreamReader(most, decoded), begin, file.size() if limit is None else limit
    while True:
        message, _ = reader.find()
        if message is not None:
            after = begin + reader.consumed
            start = after - len(message["raw"]) - len(codec.frame_header(len(message["raw"])))
            if start >= end:
                return
            yield start, after, message
        elif begin + reader.consumed >= end:
            return
        elif at < size:
            data = file.read_at(min(WINDOW, size - at), at)
            reader.feed(data)
            at += len(data)
        elif not reader.skip():
            return


def scan(part: Range, options: dict) -> Iterator[pa.RecordBatch]:
    """Batches of a range's frames. Messages are decoded by batches; where one is none, its bytes are searched on from there."""
    most, decoded = int(options.get("max_message", codec.MAX_MESSAGE)), options.get("decode", "true") != "false"
    back = max(0, part.begin - min(most + codec.HEADER_SLACK, int(options.get("lookback", LOOKBACK))))
    schema = arrow_schema(("path", pa.string()), *FRAME, after=RAW)
    reached = part.begin

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        nonlocal reached
        raw = pa.array([r[2] for r in rows], pa.binary())
        columns, errors = wire.decode(raw) if decoded else ([pa.nulls(len(rows), f.type) for f in arrow_fields()], None)
        if decoded and errors.null_count < len(errors):
            return None
        gone = []
        for at, after, _ in rows:
            gone.append(at - reached)
            reached = after
        around = [pa.array([part.path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array(gone, pa.int64())]
        return pa.RecordBatch.from_arrays([*around, *columns, raw], schema=schema)

    def whole(begin: int, certain: bool) -> Iterator[pa.RecordBatch | int]:
        """Batches from ``begin`` on, or the place of one with something that is no message, unless all are ``certain``."""
        nonlocal reached
        rows, held, resume, before, ahead = [], 0, begin, [], 0
        for at, after, message in found(f, begin, part.end, most, decoded and certain, part.limit):
            if at < part.begin:
                reached = max(reached, after)
                if decoded and not certain:
                    before.append(message["raw"])
                    ahead += after - at
                    if ahead > WINDOW:
                        if not pass_all(before):
                            yield begin
                            return
                        before, ahead = [], 0
                continue
            if before and not pass_all(before):
                yield begin
                return
            before = []
            rows.append((at, after, message["raw"]))
            held += after - at
            if len(rows) == 5000 or held > WINDOW:
                made = batch(rows)
                yield resume if made is None else made
                if made is None:
                    return
                rows, held, resume = [], 0, after
        if before and not pass_all(before):
            yield begin
        elif rows:
            made = batch(rows)
            yield resume if made is None else made

    def pass_all(raws: list[bytes]) -> bool:
        return wire.decode(pa.array(raws, pa.binary()))[1].null_count == len(raws)

    with opened(part.path) as f:
        for made in whole(back, False):
            if isinstance(made, int):
                if made == back:
                    reached = part.begin
                yield from whole(made, True)
            else:
                yield made


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        split = int(self.options.get("split", 64 << 20))
        return [Range(p, a, min(a + split, n)) for p, n in files(self.options["path"]).items() for a in range(0, n, split)] or [Range("", 0, 0)]

    def read(self, part):
        if part.path:
            yield from scan(part, self.options)


class StreamReader(DataSourceStreamReader):
    """Follows a folder: offsets hold each file's end of its last whole frame; a batch has what was added since, in ranges."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        most = int(self.options.get("max_message", codec.MAX_MESSAGE))
        out = {}
        for path, size in files(self.options["path"]).items():
            # what is already known to end in a frame needs no second look
            back = max(self.known.get(path, 0), size - 2 * (most + codec.HEADER_SLACK), 0)
            with opened(path) as f:
                last = max((after for _, after, _ in found(f, back, size, most, False, size)), default=self.known.get(path, 0))
            if last:
                out[path] = self.known[path] = last
        return out

    def partitions(self, start: dict, end: dict):
        split = int(self.options.get("split", 64 << 20))
        return [Range(p, a, min(a + split, e), e) for p, e in end.items() for a in range(start.get(p, 0), e, split)]

    def read(self, part):
        yield from scan(part, self.options)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    """A file of frames per task, moved into place when the job commits; files that it replaces go only then.

    Files are named by the time of their job and the number of their task, so sorted rows follow one another by path and offset.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f"{time.time_ns():020d}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder, _ = place(self.path)
        system.create_dir(folder, recursive=True)
        path, n = f"{folder}/.{self.job}-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.part", 0
        with system.open_output_stream(path) as f:
            for batch in batches:
                known = batch.column(batch.schema.get_field_index("raw")).to_pylist() if "raw" in batch.schema.names else [None] * batch.num_rows
                if None in known or b"" in known:
                    known = [raw or own for raw, own in zip(known, wire.encode(batch).to_pylist())]
                f.write(b"".join(part for raw in known for part in (codec.frame_header(len(raw)), raw)))
                n += len(known)
        return Written(path, n)

    def commit(self, messages) -> None:
        system, folder, scheme = place(self.path)
        old = list(files(self.path)) if self.overwrite else []
        for m in messages:
            if m is not None:
                name = m.path.rpartition("/")[2]
                system.move(m.path, f"{folder}/{name[1:].removesuffix('.part')}.framed")
        for path in old:
            system.delete_file(path.removeprefix(scheme))

    def abort(self, messages) -> None:
        system, _, _ = place(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCAN_DDL

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(FramedSource)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in even partitions, as many as its size asks for and no fewer than there are cores: coding costs more than moving rows.

    Ranges of a file tell nothing of the rows in them, for a Parquet row group is read by one task, however many ranges it spans.
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # counting partitions would run what comes before
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not _size(df) and df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(parts(df))


def _size(df: DataFrame) -> int:
    """Bytes of the stored tables below ``df``, as far as they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(n for k in range(leaves.size()) if (n := int(str(leaves.apply(k).stats().sizeInBytes()))) < UNKNOWN)


def parts(df: DataFrame) -> int:
    """How many partitions coding ``df`` should have, by the size of its tables."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-_size(df) // PART), MOST_PARTS))


_LISTS = list(VALUES.values())


def sent(df: DataFrame) -> DataFrame:
    """``df`` (messages) on its way to Python: null lists of fields are empty ones, and a number in each field tells which.

    For each row it writes, Spark walks the rows since a list column's last list to learn the batch's bytes: with lists that are
    mostly null, as all but one of a field's are, that is quadratic in the rows of a batch.
    """
    nulls = lambda f: sum((f[c].isNull().cast("int") * (1 << k) for k, c in enumerate(_LISTS)), F.lit(0))
    kind = {c.name: c.dataType for c in df.schema["fields"].dataType.elementType.fields}

    def dense(f: Column) -> Column:
        lists = [F.coalesce(f[c], F.array().cast(kind[c])).alias(c) for c in _LISTS]
        return F.when(f.isNotNull(), F.struct(*[f[n].alias(n) for n in kind if n not in _LISTS], *lists, nulls(f).alias("nulls")))

    return df.withColumn("fields", F.transform("fields", dense))


def received(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of ``sent`` messages as they were."""
    at = batch.schema.get_field_index("fields")
    lists = batch.column(at) if not batch.column(at).offset else batch.column(at).take(pa.array(range(batch.num_rows)))
    fields, member = lists.values, {f.name: f for f in arrow_fields()}["fields"].type.value_type
    nulls = fields.field("nulls").fill_null(0).to_numpy(zero_copy_only=False)
    columns = []
    for f in member:
        own = fields.field(f.name)
        if f.name in _LISTS:
            own = own if own.type == f.type else own.cast(f.type)
            gone = pa.array((nulls >> _LISTS.index(f.name)) & 1 != 0)
            own = pa.ListArray.from_arrays(own.offsets, own.values, type=f.type, mask=gone)
        columns.append(own)
    whole = pa.StructArray.from_arrays(columns, fields=list(member), mask=fields.is_null() if fields.null_count else None)
    back = pa.ListArray.from_arrays(lists.offsets, whole, mask=lists.is_null() if lists.null_count else None)
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([back if k == at else c for k, c in enumerate(batch.columns)], names)


def encoded(df: DataFrame, framed: bool = False, name: str = "pb") -> DataFrame:
    """``df`` (messages) with a binary column of each message; errors end the task."""

    def run(batches):
        for batch in map(received, batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, wire.encode(batch, framed)], [*batch.schema.names, name])

    return sent(spread(df)).mapInArrow(run, df.withColumn(name, F.lit(None).cast("binary")).schema)


def decoded(df: DataFrame, column: str = "pb", strict: bool = False, others: list[str] = ()) -> DataFrame:
    """The messages of a binary column with an error column; a message that can't be decoded has only that."""
    schema = StructType.fromDDL(f"{MESSAGE_DDL}, error string")
    schema = StructType([*df.select(*others).schema.fields, *schema.fields]) if others else schema
    # the message's own columns follow the kept ones
    names = [*HEADERS, "fields", "error"]

    def run(batches):
        for batch in batches:
            got, errors = wire.decode(batch.column(batch.schema.get_field_index(column)), strict)
            kept = [batch.column(batch.schema.get_field_index(o)) for o in others]
            yield pa.RecordBatch.from_arrays([*kept, *got, errors], [*others, *names])

    return spread(df.select(*others, column)).mapInArrow(run, schema)


def frames_of(df: DataFrame, column: str = "chunk", max_message: int = codec.MAX_MESSAGE) -> DataFrame:
    """The frames of each binary row: offset, discarded bytes before each, and the message."""
    def run(batches):
        for batch in batches:
            chunks = [data or b"" for data in batch.column(0).to_pylist()]
            # first as if every frame held a message; chunks where one doesn't are searched again, message by message
            each = [list(codec.frames(data, 0, None, max_message, False)) for data in chunks]
            columns, errors = wire.decode(pa.array([raw for got in each for _, _, raw, _ in got], pa.binary()))
            if errors.null_count < len(errors):
                each = [list(codec.frames(data, 0, None, max_message)) for data in chunks]
                columns, errors = wire.decode(pa.array([raw for got in each for _, _, raw, _ in got], pa.binary()))
            rows = [row for got in each for row in got]
            around = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*around[:2], *columns, around[2]], ["offset", "discarded", *HEADERS, "fields", "raw"])

    return spread(df.select(column)).mapInArrow(run, SCAN_DDL.removeprefix("path string, "))


def frame_header(size: Column) -> Column:
    """The bytes before a message of ``size`` bytes in a frame."""
    n, parts = size.cast("long"), []
    for k in range(5):
        rest = F.shiftright(n, 7 * k)
        byte = F.lpad(F.hex(rest.bitwiseAND(127) + F.when(rest > 127, 128).otherwise(0)), 2, "0")
        parts.append(byte if k == 0 else F.when(rest > 0, byte).otherwise(""))
    varint = F.concat(*parts)
    return F.unhex(F.concat(F.lit("1E"), F.lpad(F.hex((F.length(varint) / 2 + 1).cast("long")), 2, "0"), F.lit("08"), varint, F.lit("1F")))


def framed_size(raw: Column) -> Column:
    """Bytes of a message with its frame: the length's varint takes a byte for each 7 bits."""
    size = F.octet_length(raw)
    return size + 4 + sum(F.when(size >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 5)) + 1
