"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing. Of pages with equal payloads of at least ``LEAST`` bytes, the one with
the largest page_id becomes a response, the others revisits of it; shorter
payloads are all responses. Rows that repeat the largest id are all responses;
rows without an id are revisits where some row of their group has one. Groups
with a large share of all rows are joined by broadcast, so none is gathered.

Reading. Archives are cut into ranges of bytes. A task looks for record magic
in its range (of gzip members, or of the text header in plain archives), parses
what begins there, and emits each candidate with the offset of its successor
and that of the first successor beyond the range. Pointer jumping over ranges,
from each file's start, finds where the true chain enters every range; the
candidates on the chain from there are the records. Magic inside payloads may
make candidates, but nothing on the chain leads to them. A chain that ends
before its file does is an error.

Null html is an empty payload, a null url has no target; payloads of any length
are one record. Empty tables write no archive and read no record. Columns besides
page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.common import join_groups, marked, small_batches
from rillet.scratch import cut, shared_dir

LEAST = 1000
RANGE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = {True: rb"\x1f\x8b\x08[\x00-\x1f]", False: rb"WARC/1\.[01]\r\n"}
RECORD = pa.struct([("offset", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
SCAN = "path string, part int, records array<struct<offset:long,next:long,exit:long,page_id:long,payload_bytes:long,payload_digest:string,record_type:string,refers_to:long>>"


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha1, and refers_to where the page is a revisit.

    Payloads whose digest repeats are compared as bytes, so that different ones
    of one digest stay apart; no others are shuffled.
    """
    folder = shared_dir(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    long = rows.where(F.octet_length("html") >= LEAST).select("page_id", "html", "sha1")
    several = cut(long.groupBy("sha1").count().where("count > 1").select("sha1"), folder, "several")
    groups = marked(long, "sha1", several).where("_in").groupBy("sha1", "html").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select("sha1", F.md5("html").alias("_md5"), "first", "n"), folder, "copies")
    told = marked(rows, "sha1", several).withColumn("_in", F.col("_in") & (F.octet_length("html") >= LEAST))
    open_ = told.where("_in").drop("_in").withColumn("_md5", F.md5("html"))
    found = join_groups(open_, groups, ["sha1", "_md5"], "n", long.count(), "left").select(*rows.columns, "first")
    both = found.unionByName(told.where("not _in").select(*rows.columns, F.lit(None).cast("long").alias("first")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select(*rows.columns, F.when(again, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(pages: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Writes archives below ``folder``; returns path and size of each.

    Every attempt at a task has a file of its own; the list has only those of
    finished tasks.
    """
    small_batches(pages.sparkSession)

    def archive(batches):
        out, size, n = None, 0, 0
        system, root = place(folder)
        for batch in batches:
            for page_id, url, html, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc{'.gz' * compress}"
                    out = system.open_output_stream(path, compression=None)
                raw = record(page_id, url, html.encode(), sha1, refers)
                if compress:
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [n]})

    system, root = place(folder)
    system.create_dir(root, recursive=True)
    return cut(typed(pages).mapInArrow(archive, "path string, size long, records long"), folder, "archives")


class Source:
    """Bytes of a file by offset, read ahead."""

    def __init__(self, file, size: int, begin: int, ahead: int):
        self.file, self.size, self.begin, self.data = file, size, begin, file.read_at(min(ahead, size - begin), begin)

    def get(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if b <= self.begin + len(self.data):
            return self.data[a - self.begin : b - self.begin]
        return self.file.read_at(b - a, a) if a < b else b""


def member(source: Source, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds, and its end."""
    unpack, out, k = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            data = source.get(k, k + (1 << 16))
            if not data:
                return None
            out.append(unpack.decompress(data))
            if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                return None
            k += len(data)
    except zlib.error:
        return None
    return b"".join(out), k - len(unpack.unused_data)


def header(raw: bytes) -> tuple[dict[str, str], int] | None:
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    got = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        got[name.strip().lower()] = value.strip()
    return (got, end + 4) if got.get("content-length", "").isdigit() else None


def page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(head.get("warc-payload-digest", "sha1:")[5:]).hex()
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    refers = page(head.get("warc-refers-to"))
    if head.get("warc-type") == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {head.get('warc-record-id')} differs")
        size = len(payload)
    else:
        size = int(length[1]) if length else 0
    return {"page_id": page(head.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest, "record_type": head.get("warc-type"), "refers_to": refers}


def candidates(source: Source, begin: int, end: int, packed: bool) -> Iterator[dict]:
    """Everything in the range that looks like a record, with its successor's offset."""
    window = source.get(begin, end + 16)
    for m in re.finditer(MAGIC[packed], window):
        at = begin + m.start()
        if at >= end:
            return
        if packed:
            got = member(source, at)
            if got is None:
                continue
            raw, after = got
            head = header(raw)
        else:
            size, head = 4096, None
            while head is None and size <= 1 << 20:
                head, size = header(source.get(at, at + size)), size * 4
            after = None if head is None else at + head[1] + int(head[0]["content-length"]) + 4
            raw = b"" if head is None or after > source.size else source.get(at, after)
        if head is None or not raw:
            continue
        length = int(head[0]["content-length"])
        if raw[head[1] + length :] != b"\r\n\r\n":
            continue
        try:
            yield {"offset": at, "next": after} | parse(*[head[0], raw[head[1] : head[1] + length]])
        except ValueError:
            continue  # a chain that needs this record breaks here, which is an error


def scanned(archives: DataFrame, size: int = RANGE) -> DataFrame:
    """A row for each range with its candidates."""
    ranges = archives.select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("part", "begin"))
    ranges = ranges.repartition(max(archives.sparkSession.sparkContext.defaultParallelism * 2, 1), "path", "part")

    def scan(batches):
        for batch in batches:
            for path, total, part, begin in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = (fs.LocalFileSystem(), path) if path.startswith("/") else place(path)
                end = min(begin + size, total)
                with system.open_input_file(name) as f:
                    got = list(candidates(Source(f, total, begin, size + (1 << 16)), begin, end, name.endswith(".gz")))
                exits: dict[int, int] = {}
                for r in reversed(got):
                    r["exit"] = exits[r["offset"]] = exits.get(r["next"], r["next"])
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([got], pa.list_(RECORD))], ["path", "part", "records"])

    return ranges.mapInArrow(scan, SCAN)


def entries(ranges: DataFrame, folder: str, most: int) -> DataFrame:
    """path and offset at which the chain from each file's start enters a range; ``most`` ranges a file.

    Each round doubles the number of ranges that a jump crosses.
    """
    jumps = ranges.select("path", F.explode("records").alias("r")).select("path", F.col("r.offset").alias("offset"), F.col("r.exit").alias("exit"))
    reached = ranges.where("part = 0").select("path", F.lit(0).cast("long").alias("offset"))
    if most > 1:
        heads = jumps.select("path", F.col("exit").alias("offset")).unionByName(reached).distinct()
        jumps = cut(jumps.join(heads, ["path", "offset"], "left_semi"), folder, "jumps0")
    crossed, k = 1, 0
    while crossed < most:
        k += 1
        onward = reached.join(jumps, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = cut(reached.unionByName(onward).distinct(), folder, f"reached{k}")
        further = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("_to"))
        jumps = cut(jumps.join(further, ["path", "exit"]).select("path", "offset", F.col("_to").alias("exit")), folder, f"jumps{k}")
        crossed *= 2
    return reached


def read(archives: DataFrame, folder: str, size: int = RANGE) -> DataFrame:
    """path, offset and fields of each record of the archives (path, size)."""
    ranges = cut(scanned(archives, size), folder, "ranges")
    most = ranges.agg(F.max("part")).first()[0]
    found = entries(ranges, folder, (most or 0) + 1).withColumn("part", F.expr(f"cast(offset div {size} as int)"))
    files = archives.select("path", "size")
    joined = ranges.join(found.select("path", "part", F.col("offset").alias("at")), ["path", "part"]).join(files, "path")

    def walk(batches):
        for batch in batches:
            for path, part, got, at, total in zip(*(c.to_pylist() for c in batch.columns)):
                by, out = {r["offset"]: r for r in got}, []
                while at in by:
                    out.append(by[at])
                    at = by[at]["next"]
                if at < min((part + 1) * size, total):
                    raise ValueError(f"{path}: no record at {at}")
                names = ["offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), *[pa.array([r[n] for r in out], RECORD.field(n).type) for n in names]], ["path", *names])

    return joined.select("path", "part", "records", "at", "size").mapInArrow(walk, "path string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder).drop("path", "offset")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM p
"""
