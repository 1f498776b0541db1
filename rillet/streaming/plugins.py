"""Input, analysis and output plugins on batch and streaming DataFrames.

Plugins are plain classes. Analysis plugins keep a dict of state per key (one
key for all by default, as a single plugin instance would); it is kept as
text with a version, and starts afresh when the version changes. A batch run streams each
key's rows in order and holds only the state, never the group.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillet.functions.scalar import format_number
from rillet.operators.matcher import MessageMatcher
from rillet.schema import HEADERS, MESSAGE_DDL, message
from rillet.sources.codec import MAX_MESSAGE, StreamReader, decode_strict, encode
from rillet.sources.framed import arrow_schema

OK, FAIL, SKIP, RETRY, BATCH, ASYNC = 0, -1, -2, -3, -4, -5
OUTCOMES = {OK: "ok", FAIL: "fail", SKIP: "skip", RETRY: "retry", BATCH: "batch", ASYNC: "async"}
ERROR_SIZE, OUTPUT_LIMIT = 256, 64 << 10


class PluginTerminated(RuntimeError):
    """A plugin returned a positive code or raised; its text is cut at 255 characters."""

    def __init__(self, where: str, why: object):
        super().__init__(f"{where}() {why}"[: ERROR_SIZE - 1])


class Tools:
    """What every plugin may call on messages: coding, and matching one at hand."""

    @staticmethod
    def encode_message(fields=None, framed: bool = False, **headers) -> bytes:
        return encode(message(fields, **headers), framed)

    @staticmethod
    def decode_message(raw: bytes) -> dict:
        return decode_strict(raw)

    @staticmethod
    def create_message_matcher(expression: str) -> MessageMatcher:
        return MessageMatcher(expression)

    @staticmethod
    def create_stream_reader(most: int = MAX_MESSAGE, decode: bool = True) -> StreamReader:
        return StreamReader(most, decode)


class Emitter(Tools):
    """What an analysis plugin may call: ``inject_message``, ``inject_payload``, ``add_to_payload``, ``read_config``."""

    def __init__(self, config: dict | None = None, limit: int = OUTPUT_LIMIT):
        self.config, self.limit, self.text, self.out = config or {}, limit, [], []
        self.size = self.injected = self.injected_bytes = 0

    def read_config(self, key: str):
        return self.config.get(key)

    def inject_message(self, fields=None, **headers) -> None:
        for own in ("logger", "hostname", "pid"):
            if self.config.get(own) is not None and (self.config.get("restricted_headers", True) or headers.get(own) is None):
                headers[own] = self.config[own]
        m = message(fields, **headers)
        self.injected, self.injected_bytes = self.injected + 1, self.injected_bytes + len(encode(m))
        self.out.append(m)

    def add_to_payload(self, *values) -> None:
        if not values:
            raise ValueError("add_to_payload() must have at least one argument")
        for v in values:
            if v is None or isinstance(v, bool):
                v = {None: "nil", True: "true", False: "false"}[v]
            elif isinstance(v, (int, float)):
                v = format_number(float(v))
            elif not isinstance(v, str):
                raise ValueError(f"add_to_payload() unsupported type: {type(v).__name__}")
            self.size += len(v.encode())
            if self.limit and self.size > self.limit:
                raise ValueError("output_limit exceeded")
            self.text.append(v)

    def inject_payload(self, payload_type: str = "txt", payload_name: str | None = None, *values, timestamp: int = 0) -> None:
        if values:
            self.add_to_payload(*values)
        text, self.text, self.size = "".join(self.text), [], 0
        if text:
            fields = [{"name": "payload_type", "value": payload_type}]
            fields += [{"name": "payload_name", "value": payload_name}] if payload_name is not None else []
            self.inject_message(fields, type="inject_payload", payload=text, timestamp=timestamp)

    def take(self) -> list[dict]:
        out, self.out = self.out, []
        return out


class AnalysisPlugin:
    """Override ``process_message`` (0 ok, -1 a counted failure, above 0 ends the plugin) and ``timer_event``."""

    version = 0

    def process_message(self, msg: dict, state: dict, emit: Emitter) -> int:
        return OK

    def timer_event(self, ns: int, shutdown: bool, state: dict, emit: Emitter) -> None:
        pass


def preserve(state: dict, version: int = 0) -> str:
    """State as text: dicts with keys of any scalar, lists, tuples, text, bytes, numbers, truth values and None.

    What is shared or refers to itself stays so; infinities and NaN are kept.
    Functions and other objects are left out, but as keys they are an error.
    """
    nodes: list = []
    places: dict[int, int] = {}

    def scalar(v):
        return {"b": v.hex()} if isinstance(v, bytes) else v

    def held(v) -> bool:
        return v is None or isinstance(v, (str, bool, int, float, bytes, list, tuple, dict))

    def refer(v):
        if not isinstance(v, (list, tuple, dict)):
            return scalar(v)
        if id(v) not in places:
            places[id(v)] = len(nodes)
            nodes.append(None)
            todo.append(v)
        return {"at": places[id(v)]}

    todo: list = []
    root = refer(state)
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            bad = next((k for k in v if not isinstance(k, (str, bool, int, float, bytes))), None)
            if bad is not None:
                raise ValueError(f"unsupported key type: {'function' if callable(bad) else type(bad).__name__}")
            nodes[places[id(v)]] = {"pairs": [[scalar(k), refer(x)] for k, x in v.items() if held(x)]}
        else:
            nodes[places[id(v)]] = {"list": [refer(x) for x in v if held(x)]}
    return json.dumps({"version": version, "root": root, "nodes": nodes})


def restore(text: str | None, version: int = 0) -> dict:
    """State from ``preserve``; empty for none or for another version."""
    if not text:
        return {}
    got = json.loads(text)
    if got.get("version") != version:
        return {}
    made = [{} if "pairs" in n else [] for n in got["nodes"]]

    def value(v):
        return v if not isinstance(v, dict) else bytes.fromhex(v["b"]) if "b" in v else made[v["at"]]

    for node, own in zip(got["nodes"], made):
        if "pairs" in node:
            own.update((value(k), value(x)) for k, x in node["pairs"])
        else:
            own.extend(map(value, node["list"]))
    return value(got["root"])


def call(plugin: AnalysisPlugin, msg: dict, state: dict, emit: Emitter) -> int:
    try:
        rv = plugin.process_message(msg, state, emit)
    except Exception as e:
        raise PluginTerminated("process_message", e) from e
    rv = OK if rv is None else rv
    if not isinstance(rv, int) or isinstance(rv, bool):
        raise PluginTerminated("process_message", "must return a numeric status code")
    if rv > 0:
        raise PluginTerminated("process_message", f"returned {rv}")
    return rv


def analyse(df: DataFrame, plugin: AnalysisPlugin, key: str | None = None, order: str = "timestamp", config: dict | None = None, previous: DataFrame | None = None, ns: int = 0) -> DataFrame:
    """Runs ``plugin`` over a bounded table of messages, then its final timer event, key by key.

    Returns the injected messages with the columns key, kind ('message', or one
    'state' row for each key, whose payload is the preserved state), processed
    and failures. ``previous`` gives such state rows to start from; they pass
    ahead of their key's messages, for a join before the shuffle by key may
    take its place, and adaptive execution then splits keys over tasks.
    """
    keyed = df.withColumn("_key", F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit("")))
    keyed = keyed.withColumns({"_old": F.lit(None).cast("string"), "_message": F.lit(True)})
    if previous is not None:
        old = previous.where("kind = 'state'").select(F.col("key").alias("_key"), F.col("payload").alias("_old"), F.lit(False).alias("_message"))
        keyed = keyed.unionByName(old, allowMissingColumns=True)
    ordered = keyed.repartition("_key").sortWithinPartitions("_key", "_message", order)
    ddl = f"key string, kind string, processed bigint, failures bigint, {MESSAGE_DDL}"
    schema = arrow_schema(("key", pa.string()), ("kind", pa.string()), ("processed", pa.int64()), ("failures", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]):
        now, state, emit, n, bad, out, kept = None, {}, None, 0, 0, [], (None, None)

        def close():
            plugin.timer_event(ns, True, state, emit)
            last = [{"key": now, "kind": "message"} | m for m in emit.take()]
            return [*last, {"key": now, "kind": "state", "processed": n, "failures": bad, "payload": preserve(state, plugin.version)}]

        for batch in batches:
            for row in batch.to_pylist():
                k, old = row.pop("_key"), row.pop("_old")
                if not row.pop("_message"):
                    kept = k, old
                    continue
                if k != now:
                    if now is not None:
                        out += close()
                    now, state, emit, n, bad = k, restore(kept[1] if kept[0] == k else None, plugin.version), Emitter(config), 0, 0
                n += 1
                bad += call(plugin, row, state, emit) == FAIL
                out += [{"key": now, "kind": "message"} | m for m in emit.take()]
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            out += close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, ddl)


class _Processor(StatefulProcessor):
    def __init__(self, plugin: AnalysisPlugin, interval: float, config: dict | None):
        self.plugin, self.interval, self.config = plugin, interval, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("state", "text string")

    def _frame(self, key, emit: Emitter, n: int, bad: int) -> pd.DataFrame:
        blank = {"processed": None, "failures": None} | dict.fromkeys([*HEADERS, "fields"])
        rows = [blank | {"key": key[0], "kind": "message"} | m for m in emit.take()]
        rows.append(blank | {"key": key[0], "kind": "state", "processed": n, "failures": bad, "payload": self.text})
        frame = pd.DataFrame(rows, columns=["key", "kind", "processed", "failures", *HEADERS, "fields"], dtype=object)
        return frame.astype({c: "Int64" for c in ("processed", "failures", "timestamp")} | {c: "Int32" for c in ("severity", "pid")})

    def _state(self) -> dict:
        return restore(self.kept.get()[0] if self.kept.exists() else None, self.plugin.version)

    def _keep(self, state: dict) -> None:
        self.text = preserve(state, self.plugin.version)
        self.kept.update((self.text,))

    def handleInputRows(self, key, rows, timerValues):
        state, emit, n, bad = self._state(), Emitter(self.config), 0, 0
        for frame in rows:
            for msg in frame.to_dict("records"):
                n += 1
                bad += call(self.plugin, msg, state, emit) == FAIL
        self._keep(state)
        if self.interval and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.interval * 1000))
        yield self._frame(key, emit, n, bad)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, emit = self._state(), Emitter(self.config)
        self.plugin.timer_event(expiredTimerInfo.getExpiryTimeInMs() // 1000 * 10**9, False, state, emit)
        self._keep(state)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.interval * 1000))
        yield self._frame(key, emit, 0, 0)

    def close(self) -> None:
        pass


def analyse_stream(df: DataFrame, plugin: AnalysisPlugin, key: str | None = None, interval: float = 0, config: dict | None = None) -> DataFrame:
    """Runs ``plugin`` over a stream with its state in the state store.

    Rows: key, kind, processed, failures, and a message's columns; kind
    'message' for injected messages, 'state' for the state after each batch, in
    payload. ``interval`` seconds of processing time bring timer events; such
    queries are stopped by whoever runs them, who then calls ``finish`` with the
    rows of state. Needs the RocksDB state store provider.
    """
    keyed = df.withColumn("_key", F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit("")))
    return keyed.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=_Processor(plugin, interval, config), outputStructType=f"key string, kind string, processed bigint, failures bigint, {MESSAGE_DDL}",
        outputMode="Update", timeMode="ProcessingTime" if interval else "None",
    )


def finish(states: DataFrame, plugin: AnalysisPlugin, config: dict | None = None, ns: int = 0) -> DataFrame:
    """The messages of the last timer event of each key, from its last row of state, of which ``states`` has one for each key.

    For streams, whose end Spark doesn't tell their state.
    """
    latest = states.where("kind = 'state'").select("key", "payload")
    schema = arrow_schema(("key", pa.string()))

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                emit = Emitter(config)
                plugin.timer_event(ns, True, restore(text, plugin.version), emit)
                out += [{"key": k} | m for m in emit.take()]
            yield pa.RecordBatch.from_pylist(out, schema)

    return latest.mapInArrow(run, f"key string, {MESSAGE_DDL}")


class Checkpoint:
    """What an output plugin has confirmed: all it batched so far, or what it sent by itself up to a sequence."""

    def __init__(self):
        self.seen = self.batched = self.sent = None
        self.failures = 0

    def update(self, sequence=None, failures: int = 0) -> None:
        """Without ``sequence``, confirms what was batched; else what was sent asynchronously up to it."""
        if failures < 0:
            raise ValueError("update_checkpoint() failures must not be negative")
        self.failures += failures
        if sequence is None:
            self.batched = self.seen
        else:
            self.sent = sequence if self.sent is None else max(self.sent, sequence)


class OutputPlugin(Tools):
    """Override ``process_message``; it returns 0, -1 to -5, or above 0 to end. ``flush`` writes what was batched.

    ``update_checkpoint`` confirms batched and asynchronous messages.
    """

    checkpoint: Checkpoint | None = None

    def update_checkpoint(self, sequence=None, failures: int = 0) -> None:
        self.checkpoint.update(sequence, failures)

    def process_message(self, msg: dict, sequence: int) -> int:
        return OK

    def flush(self, shutdown: bool) -> int:
        return OK


def deliver(df: DataFrame, plugin: OutputPlugin, sequence: str = "offset", retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Sends every message once; returns sequence, rv, outcome, attempts, whether it moves the checkpoint, and failures reported later.

    A retry repeats the message after ``wait`` seconds, at most ``retries``
    times, then counts as a failure. Batched messages are acknowledged by
    ``update_checkpoint()`` or by the flush at the end of their task;
    asynchronous ones by ``update_checkpoint(sequence)``. A task holds only rows
    that wait for that.
    """
    names = ["sequence", "rv", "outcome", "attempts", "acknowledged", "late_failures"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int64()]

    def run(batches):
        plugin.checkpoint = mark = Checkpoint()
        waiting: list[tuple] = []

        def settled(rows: list[tuple]) -> pa.RecordBatch:
            late, mark.failures = mark.failures, 0
            columns = [[s for s, *_ in rows], [rv for _, rv, *_ in rows], [OUTCOMES[rv] for _, rv, *_ in rows], [n for _, _, n, _ in rows], [ok for *_, ok in rows], [late * (k == 0) for k in range(len(rows))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def confirmed(s, rv) -> bool:
            upto = mark.batched if rv == BATCH else mark.sent
            return upto is not None and s <= upto

        for batch in batches:
            done = []
            for msg in batch.to_pylist():
                attempts, mark.seen = 1, msg[sequence]
                while (rv := plugin.process_message(msg, msg[sequence])) == RETRY and attempts <= retries:
                    time.sleep(wait)
                    attempts += 1
                rv = FAIL if rv == RETRY else OK if rv is None else rv
                if rv > 0 or rv not in OUTCOMES:
                    raise PluginTerminated("process_message", f"returned {rv}")
                (waiting if rv in (BATCH, ASYNC) else done).append((msg[sequence], rv, attempts, True))
            done += [r for r in waiting if confirmed(*r[:2])]
            waiting[:] = [r for r in waiting if not confirmed(*r[:2])]
            if done:
                yield settled(done)
        flushed = plugin.flush(True) == OK
        rest = [(s, rv, n, confirmed(s, rv) or rv == BATCH and flushed) for s, rv, n, _ in waiting]
        if rest:
            yield settled(rest)

    return df.mapInArrow(run, "sequence long, rv int, outcome string, attempts int, acknowledged boolean, late_failures long")


def delivery_counts(outcomes: DataFrame) -> DataFrame:
    """pm_cnt counts all calls but retries; failures count once, those that plugins reported later too."""
    failures = F.count_if(F.col("rv") == FAIL) + F.coalesce(F.sum("late_failures"), F.lit(0))
    return outcomes.agg(F.count_if(F.col("rv") != RETRY).alias("pm_cnt"), failures.alias("pm_failures"), F.max(F.when(F.col("acknowledged"), F.col("sequence"))).alias("checkpoint"))


def deliver_stream(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", once: bool = False, done: Callable[[int], bool] | None = None):
    """Starts a query that hands each micro-batch to ``sink``; batches that ``done`` knows are skipped, so repeats are harmless."""

    def batch(rows: DataFrame, number: int) -> None:
        if done is None or not done(number):
            sink(rows, number)

    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class InputPlugin(Tools):
    """Override ``process_message``: yields (message, checkpoint) from the given checkpoint, a number, text or None, on.

    A message is a dict, the bytes of an encoded one, what a stream reader
    found, or None, which moves the checkpoint alone.
    """

    def process_message(self, checkpoint) -> Iterator[tuple[dict, object]]:
        return iter(())


def input_source(plugin: InputPlugin, name: str) -> type[DataSource]:
    """A data source of that name: a batch read runs the plugin once, a stream polls it from its last checkpoint."""
    schema = f"checkpoint string, {MESSAGE_DDL}"

    def rows(checkpoint):
        for m, at in plugin.process_message(checkpoint):
            if m is None:
                yield None, at
                continue
            m = decode_strict(m) if isinstance(m, (bytes, bytearray)) else m
            nested = [Row(**f) for f in m["fields"]]
            yield (json.dumps(at), *[m[h] for h in ("uuid", "timestamp", "type", "logger", "severity", "payload", "env_version", "pid", "hostname")], nested), at

    class Batch(DataSourceReader):
        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            for row, _ in rows(None):
                if row is not None:
                    yield row

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self):
            return {"checkpoint": None}

        def read(self, start):
            got, last = [], start["checkpoint"]
            for row, at in rows(last):
                got += [row] if row is not None else []
                last = last if at is None else at
            return iter(got), {"checkpoint": last}

        def readBetweenOffsets(self, start, end):
            for row, at in rows(start["checkpoint"]):
                if row is not None:
                    yield row
                if at == end["checkpoint"]:
                    break

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Batch()

        def simpleStreamReader(self, schema):
            return Stream()

    return Source


def register_input(spark: SparkSession, plugin: InputPlugin, name: str) -> None:
    spark.dataSource.register(input_source(plugin, name))


