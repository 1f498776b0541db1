"""Counting, viewing, filtering and following framed logs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.functions.scalar import unescape
from rillet.operators.matcher import matcher
from rillet.operators.stats import match_counts
from rillet.schema import HEADERS, VALUES
from rillet.sources import framed

MAX_MESSAGE = 1 << 30


def load(spark: SparkSession, path: str, max_message: int = MAX_MESSAGE) -> DataFrame:
    framed.register(spark)
    return spark.read.format("framed").option("max_message", str(max_message)).load(path)


def count(messages: DataFrame, expression: str = "TRUE") -> DataFrame:
    return match_counts(messages, matcher(unescape(expression)))


def select(messages: DataFrame, expression: str = "TRUE", last: int | None = None, order: str | list[str] | None = None) -> DataFrame:
    """Matching messages; of the ``last`` messages only, if that is given and not 0.

    Messages of files follow one another by path and offset.
    """
    if last:
        order = [order] if isinstance(order, str) else order or [c for c in ("path", "offset") if c in messages.columns]
        messages = messages.orderBy(*map(F.desc, order)).limit(last)
    return messages.where(matcher(unescape(expression)))


def printed(raw: bytes) -> str:
    return "".join("\\\\" if b == 0x5C else chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in raw)


_SHOW = [str, printed, str, lambda d: "%.17g" % d, lambda b: "true" if b else "false"]
_EPOCH = dt.datetime(1970, 1, 1)
_nil = lambda v: "<nil>" if v is None else v


def _head(uuid: bytes, timestamp: int, kind, logger, severity, payload, env_version, pid, hostname) -> str:
    u = uuid.hex()
    seconds, ns = divmod(timestamp, 10**9)
    at = _EPOCH + dt.timedelta(seconds=seconds)
    return (
        f":Uuid: {u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}\n:Timestamp: {at.isoformat(timespec='seconds')}.{ns:09d}Z\n:Type: {_nil(kind)}\n:Logger: {_nil(logger)}\n:Severity: {_nil(severity)}\n"
        f":Payload: {_nil(payload)}\n:EnvVersion: {_nil(env_version)}\n:Pid: {_nil(pid)}\n:Hostname: {_nil(hostname)}\n:Fields:\n"
    )


def _line(name: str, kind: int, representation: str | None, values: list | None) -> str:
    return f"    | name: {name} type: {kind} representation: {_nil(representation)} value: {'|'.join(map(_SHOW[kind], values or []))}\n"


def text_of(m: dict) -> str:
    lines = [_line(f["name"], f["value_type"], f["representation"], f[VALUES[f["value_type"]]]) for f in m["fields"] or []]
    return _head(*(m[h] for h in HEADERS)) + "".join(lines) + "\n"


def texts(batch: pa.RecordBatch) -> list[str]:
    """``text_of`` of each message, from whole columns: of a field's lists only that of its type is looked at."""
    of = lambda name: batch.column(batch.schema.get_field_index(name))
    lists = of("fields")
    fields, at = lists.values, lists.offsets.to_pylist()
    kinds = fields.field("value_type")
    if lists.null_count or fields.null_count or kinds.null_count or not set(kinds.unique().to_pylist()) <= set(VALUES):
        return [text_of(r) for r in batch.select([*HEADERS, "fields"]).to_pylist()]
    kinds = kinds.to_numpy(zero_copy_only=False)
    names, shown, lines = fields.field("name").to_pylist(), fields.field("representation").to_pylist(), [""] * len(fields)
    for kind, column in VALUES.items():
        mine = np.flatnonzero(kinds == kind)
        for k, values in zip(mine.tolist(), fields.field(column).take(pa.array(mine)).to_pylist()):
            lines[k] = _line(names[k], kind, shown[k], values)
    heads = map(_head, *(of(h).to_pylist() for h in HEADERS))
    return [head + "".join(lines[a:b]) + "\n" for head, a, b in zip(heads, at, at[1:])]


def text(messages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and a text view of each message."""
    names = [*keep, "text"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(texts(batch), pa.string())], names)

    needed = list(dict.fromkeys([*keep, *HEADERS, "fields"]))
    sent = framed.sent(framed.spread(messages.select(*needed)))
    if "fields" in keep:
        return sent.mapInArrow(lambda batches: run(map(framed.received, batches)), messages.select(*keep, F.lit("").alias("text")).schema)
    return sent.mapInArrow(run, messages.select(*keep, F.lit("").alias("text")).schema)


def frames(messages: DataFrame) -> DataFrame:
    """Each message in its frame, the original bytes where they are known."""
    raw = messages if "raw" in messages.columns else framed.encoded(messages, name="raw")
    return raw.select("raw")


def _discarded(path: str) -> Column:
    size = sum(framed.files(path).values())
    return (F.lit(size) - F.coalesce(F.sum(framed.framed_size(F.col("raw")).cast("long")), F.lit(0))).alias("discarded")


def discarded(messages: DataFrame, path: str) -> DataFrame:
    """How many bytes of the files of ``messages`` are in no frame, what follows the last one included."""
    return messages.agg(_discarded(path))


def counts(messages: DataFrame, path: str, expression: str = "TRUE") -> DataFrame:
    """processed, matched and discarded in one pass over the files."""
    return match_counts(messages, matcher(unescape(expression)), _discarded(path))


def follow(spark: SparkSession, path: str, expression: str = "TRUE", max_message: int | None = None) -> DataFrame:
    """A stream of matching messages as files grow; run it with a trigger of one second (``followed``)."""
    framed.register(spark)
    reader = spark.readStream.format("framed")
    reader = reader if max_message is None else reader.option("max_message", str(max_message))
    return reader.load(path).where(matcher(unescape(expression)))


def followed(messages: DataFrame, sink, checkpoint: str, interval: str = "1 second", once: bool = False):
    """Starts a query that hands the messages of each interval to ``sink``, with a number that repeats after a failure."""
    writer = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
