import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillet.schema import HEADERS, MessageError, arrow_fields, message, uuid_bytes
from rillet.sources import codec, wire

U = b"\x0a\x10" + b"\0" * 16
T = b"\x10\x00"


@pytest.mark.parametrize("value, raw", [(0, b"\0"), (16, b"\x10"), (300, b"\xac\x02"), (-1, b"\xff" * 9 + b"\x01"), (5000000000, b"\x80\xe4\x97\xd0\x12")])
def test_varint(value, raw):
    assert codec.varint(value) == raw and codec.read_varint(raw, 0, len(raw)) == (value, len(raw))


GOOD = [b"", b"\x1a\x04Type", b"\x22\x01l", b"\x28\x07", b"\x32\x01p", b"\x3a\x02ev", b"\x40\x11", b"\x4a\x01h", b"\x52\x0a\x0a\x03foo\x22\x03bar"]


@pytest.mark.parametrize("rest", GOOD)
def test_decodes(rest):
    assert codec.decode(U + T + rest)["uuid"] == b"\0" * 16


BAD = {b"\x10\x00": "missing Uuid", U: "missing Timestamp", b"\x0a\x01\xff": "tag:1 wiretype:2 position:0", b"\xf0": "tag:30 wiretype:0 position:0", b"\x11": "tag:2 wiretype:1 position:0", b"\x53": "tag:10 wiretype:3 position:0", b"\x52\x10": "tag:10 wiretype:2 position:0", b"\x52\x01\x4b": "tag:10 wiretype:2 position:0", b"\x52\x05\x22\x03bar": "tag:10 wiretype:2 position:0", b"\x10" + b"\xff" * 11: "tag:2 wiretype:0 position:0", U + T + b"\x28": "tag:5 wiretype:0 position:20"}


@pytest.mark.parametrize("raw", BAD)
def test_errors(raw):
    with pytest.raises(codec.DecodeError) as e:
        codec.decode(raw)
    assert str(e.value) == BAD[raw]


def test_strict_errors():
    for raw, text in ((b"abc", "invalid message, too short"), (U + b"\x28\x01", "missing required field uuid: found timestamp: not found"), (U + T + b"\xf0", "error in tag: 30 wiretype: 0 offset: 20")):
        with pytest.raises(codec.DecodeError, match=text):
            codec.decode_strict(raw)


def test_unpacked_and_packed():
    f = lambda body: codec.decode(U + T + codec._part(10, b"\x0a\x01n\x10\x02" + body))["fields"][0]["value_integer"]
    assert f(b"\x30\x01\x30\x02") == f(b"\x32\x02\x01\x02") == [1, 2]
    assert f(b"\x30" + codec.varint(-5)) == [-5]
    d = codec.decode(U + b"\x10" + codec.varint(-7) + b"\x40" + codec.varint(-2))
    assert (d["timestamp"], d["pid"], d["severity"]) == (-7, -2, 7)


def test_encoding():
    m = message({"key": {"value": 34, "value_type": 2, "representation": "widget"}}, uuid=bytes(16), logger="l", hostname="h", severity=None)
    assert codec.encode(m) == U + T + b"\x22\x01l\x4a\x01h" + b"\x52\x11\x0a\x03key\x10\x02\x1a\x06widget\x30\x22"
    m = message([{"name": "n", "value": [1, 2]}, {"name": "b", "value": [True, False]}, {"name": "s", "value": ["x", "y"]}], uuid=bytes(16))
    assert codec.encode(m)[22:] == b"\x52\x17\x0a\x01n\x10\x03\x3a\x10" + struct.pack("<2d", 1, 2) + b"\x52\x09\x0a\x01b\x10\x04\x42\x02\x01\x00" + b"\x52\x09\x0a\x01s\x22\x01x\x22\x01y"
    assert codec.frame_header(20) == b"\x1e\x02\x08\x14\x1f"


@pytest.mark.parametrize("value, kind, text", [([2, "ten"], None, "mixed types"), ([], None, "unsupported type: nil"), ([[1], [2]], None, "unsupported array type"), ("s", 2, "invalid string value_type: 2"), (1, 0, "invalid numeric value_type: 0"), (True, 2, "invalid boolean value_type: 2")])
def test_message_errors(value, kind, text):
    with pytest.raises(MessageError, match=text):
        message([{"name": "a", "value": value, "value_type": kind}])


def test_uuid():
    assert uuid_bytes("00112233-4455-6677-8899-aabbccddeeff").hex() == "00112233445566778899aabbccddeeff"
    assert uuid_bytes(b"0123456789abcdef") == b"0123456789abcdef" and len(uuid_bytes("x")) == 16


def test_incremental_scan():
    r = codec.StreamReader(100)
    body = U + T
    h = bytes.fromhex
    steps = [
        (h("1e0208141f") + body, True, 0), (h("1e"), False, 0), (h("0208"), False, 0), (h("141f") + U, False, 0), (T + h("1e0208141f"), True, 0), (body, True, 0),
        (body, False, 20), (h("1e0208151f") + body + h("00"), False, 26), (h("1e0208001f"), False, 5), (h("1e020814011f"), False, 6), (h("1e0209141f"), False, 5), (h("1e0208651f"), False, 5),
    ]
    for chunk, found, discarded in steps:
        r.feed(chunk)
        m, d = r.find()
        assert (m is not None, d) == (found, discarded), chunk


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6).filter(lambda b: b"\x1e" not in b), st.text(max_size=5)), max_size=6))
def test_frames_round_trip(parts):
    data, want = b"", []
    for noise, text in parts:
        raw = codec.encode(message({"t": text or "x"}, uuid=bytes(16), payload=text))
        data += noise + codec.frame_header(len(raw)) + raw
        want.append((len(noise), text))
    assert [(d, m["payload"]) for _, d, _, m in codec.frames(data)] == want


def test_source_and_sink(spark, tmp_path):
    from rillet.operators import cat
    from rillet.plans.adapters import event_messages
    from rillet.sources import framed

    framed.register(spark)
    events = event_messages(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "log")
    framed.encoded(events, name="raw").repartition(3).write.format("framed").mode("append").save(path)
    back = cat.load(spark, path)
    assert back.count() == events.count()
    split = spark.read.format("framed").option("split", "5000").option("max_message", "1000").load(path)
    assert split.select("path", "offset").exceptAll(back.select("path", "offset")).isEmpty() and split.count() == back.count()
    want = events.groupBy("type").count().collect()
    assert sorted(want) == sorted(back.groupBy("type").count().collect())
    assert cat.count(back, "Type == 'error'").first().matched == events.where("type = 'error'").count()
    assert cat.select(back, "TRUE", 0).count() == back.count()
    files = framed.files(path)
    last = sorted(back.select("path", "offset").collect())[-40:]
    assert sorted((r.path, r.offset) for r in cat.select(back, "TRUE", 40).collect()) == [tuple(r) for r in last]
    # two files: the last messages are those of the later name, however large the offsets of the other
    small = tmp_path / "many"
    small.mkdir()
    raws = [bytes(r.raw) for r in back.limit(9).collect()]
    frame = lambda raw: codec.frame_header(len(raw)) + raw
    (small / "1-old.log").write_bytes(b"".join(map(frame, raws[:7])) + b"tail")
    (small / "2-new.log").write_bytes(b"\x1e\x02" + b"".join(map(frame, raws[7:])) + codec.frame_header(500) + b"cut")
    two = cat.load(spark, str(small))
    assert [r.path.rpartition("/")[2] for r in cat.select(two, "TRUE", 3).orderBy("path").collect()] == ["1-old.log", "2-new.log", "2-new.log"]
    assert cat.discarded(two, str(small)).first().discarded == 4 + 2 + len(codec.frame_header(500)) + 3
    assert two.count() == 9 == cat.load(spark, f"file://{small}").count() == cat.load(spark, f"{small}/*.log").count() and cat.load(spark, f"{small}/1*").count() == 7
    # overwriting replaces files only once the new ones are in place
    two.limit(4).write.format("framed").mode("overwrite").save(str(small))
    assert cat.load(spark, str(small)).count() == 4 and not set(framed.files(str(small))) & {str(small / "1-old.log")}
    assert len(files) == len(framed.files(path))
    stream = cat.follow(spark, path, "Severity < 7")
    q = stream.writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("followed").count() == events.where("severity < 7").count()


def test_text_view():
    from rillet.operators.cat import text_of

    m = message([{"name": "b", "value": b"a\\\x01"}, {"name": "d", "value": [1.5, 2.0]}, {"name": "t", "value": True}], uuid=bytes(16), timestamp=-1, type="x")
    text = text_of(m)
    assert ":Timestamp: 1969-12-31T23:59:59.999999999Z" in text and "value: a\\\\\\x01\n" in text and "value: 1.5|2\n" in text and ":Logger: <nil>" in text and "value: true" in text


def test_texts_of_batches():
    from rillet.operators.cat import text_of, texts

    rows, _ = odd_messages(200)
    rows = [r | {"timestamp": r["timestamp"] % 2**60} for r in rows]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(arrow_fields()))
    assert texts(batch) == [text_of(r) for r in rows] and texts(batch.slice(20, 50)) == [text_of(r) for r in rows[20:70]]
    rows[3]["fields"] = None
    assert texts(pa.RecordBatch.from_pylist(rows, batch.schema)) == [text_of(r) for r in rows]


def test_sorted_rows_follow_one_another_in_files(spark, tmp_path):
    """Sorted messages are written by more tasks than one, and their order is that of path and offset, also over two jobs."""
    from rillet.operators import cat
    from rillet.plans import catalog
    from rillet.sources import framed

    path = catalog._written(spark, "/root/testdata/sf0.001", True)
    back = [bytes(r.uuid) for r in cat.load(spark, path).orderBy("path", "offset").select("uuid").collect()]
    want = [bytes(r.uuid) for r in catalog.events(spark, "/root/testdata/sf0.001").orderBy("event_id").select("uuid").collect()]
    assert back == want and len(framed.files(path)) > 1
    framed.encoded(catalog.event_messages(spark, "/root/testdata/sf0.001").limit(5), name="raw").select("raw").write.format("framed").mode("append").save(path)
    tail = {bytes(r.uuid) for r in cat.select(cat.load(spark, path), "TRUE", 5).collect()}
    assert tail == {bytes(r.uuid) for r in catalog.events(spark, "/root/testdata/sf0.001").limit(5).collect()}


def test_messages_ahead_of_a_range_are_checked_together(tmp_path, monkeypatch):
    from rillet.sources import framed

    rows, _ = odd_messages(300)
    raws = [codec.encode(m) for m in rows]
    data = b"".join(codec.frame_header(len(raw)) + raw for raw in raws)
    path, calls, decode = str(tmp_path / "log"), [], wire.decode
    open(path, "wb").write(data)
    monkeypatch.setattr(wire, "decode", lambda *a: calls.append(1) or decode(*a))
    half = len(data) // 2
    got = sum(b.num_rows for b in framed.scan(framed.Range(path, half, len(data)), {}))
    assert got == sum(at >= half for at, *_ in codec.frames(data)) and len(calls) <= 2


def odd_messages(n, seed=1):
    import random

    rng = random.Random(seed)
    raw = lambda k: bytes(rng.randrange(256) for _ in range(k))

    def value():
        kind = rng.randrange(5)
        make = [lambda: rng.choice(["", "x", "é" * 3, "long " * 50]), lambda: raw(rng.randrange(5)), lambda: rng.choice([0, 5, -1, 300, 2**40, -(2**62)]), lambda: rng.random() * 10 ** rng.randrange(9), lambda: rng.random() < 0.5][kind]
        return {"name": rng.choice(["a", "bb", "ñ"]), "value": [make() for _ in range(rng.choice([1, 1, 2, 5]))], "value_type": kind, "representation": rng.choice([None, "u"])}

    headers = lambda: dict(uuid=raw(16), timestamp=rng.choice([0, 5, -7, 2**60]), type=rng.choice([None, "t", "é"]), logger=rng.choice([None, ""]), severity=rng.choice([None, 0, 7]), payload=rng.choice([None, "p" * 300]), pid=rng.choice([None, -2, 5]), hostname=rng.choice([None, "h"]))  # noqa: E731, C408
    return [message([value() for _ in range(rng.randrange(6))], **headers()) for _ in range(n)], rng


def test_batches_as_single_messages():
    """Batches are coded to what single messages are, broken ones included."""
    rows, rng = odd_messages(800)
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(arrow_fields()))
    for frame in (False, True):
        assert wire.encode(batch, frame).to_pylist() == [codec.encode(m, frame) for m in rows]
    raws = [codec.encode(m) for m in rows]
    for k in range(0, len(raws), 2):
        changed = bytearray(raws[k])
        for _ in range(rng.randrange(1, 3)):
            changed[rng.randrange(len(changed))] = rng.randrange(256)
        raws[k] = bytes(changed[: rng.choice([len(changed), len(changed), rng.randrange(len(changed) + 1)])])
    for strict in (False, True):
        columns, errors = wire.decode(pa.array([b"", *raws, None, b"\x0a"], pa.binary()), strict)
        got = pa.RecordBatch.from_arrays([*columns, errors], [*HEADERS, "fields", "error"])
        got.validate(full=True)
        for row, raw in zip(got.to_pylist(), [b"", *raws, b"", b"\x0a"], strict=True):
            try:
                want = (codec.decode_strict if strict else codec.decode)(raw) | {"error": None}
            except codec.DecodeError as e:
                want = {"error": str(e)}
            assert repr(row) == repr({k: want.get(k) for k in row})
    assert wire.encode(batch.slice(0, 0)).to_pylist() == [] and len(wire.decode(pa.array([], pa.binary()))[1]) == 0
    sliced = batch.slice(100, 50)
    assert wire.encode(sliced).to_pylist() == [codec.encode(m) for m in rows[100:150]]
    with pytest.raises(MessageError):
        wire.encode(pa.RecordBatch.from_pylist([rows[0] | {"fields": [{"name": "n", "value_type": 2, "value_integer": []}]}], pa.schema(arrow_fields())))


def test_scan_of_broken_files(tmp_path):
    """Ranges of any length give the frames of the whole file, where some frames hold no message."""
    from rillet.sources import framed

    rows, rng = odd_messages(60, 4)
    data = b""
    for m in rows:
        raw = codec.encode(m)
        if rng.random() < 0.2:
            inner = codec.encode(rows[0])
            raw = b"\xf0" + codec.frame_header(len(inner)) + inner  # a frame of no message, which holds one that is
        data += rng.choice([b"", b"noise", b"\x1e\x02\x08"]) + codec.frame_header(len(raw)) + raw
    path = str(tmp_path / "log")
    open(path, "wb").write(data + b"\x1e\x02\x08\x7f\x1f")
    want = [(at, gone, raw) for at, gone, raw, _ in codec.frames(data)]
    for step in (len(data), 1000, 97):
        got = []
        for a in range(0, len(data), step):
            for batch in framed.scan(framed.Range(path, a, min(a + step, len(data))), {"max_message": "4000"}):
                got += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(batch.schema.get_field_index("raw")).to_pylist())
        assert [(at, raw) for at, _, raw in got] == [(at, raw) for at, _, raw in want]
        if step == len(data):
            assert got == want


def test_lists_on_their_way_to_python(spark):
    """Null lists go as empty ones, which Spark writes in linear time, and come back null; empty ones and null fields stay."""
    from rillet.schema import MESSAGE_DDL
    from rillet.sources import framed

    rows, _ = odd_messages(30)
    rows += [rows[0] | {"fields": None}, rows[0] | {"fields": []}, rows[0] | {"fields": [None, *rows[1]["fields"]]}, rows[0] | {"fields": [{"name": "e", "value_type": 2, "value_integer": [], "value_bool": None}]}]
    df = spark.createDataFrame([{"fields": None} | r for r in rows], MESSAGE_DDL)
    lists = framed._LISTS
    for r in framed.sent(df).collect():
        assert all(f[c] is not None for f in r.fields or [] if f is not None for c in lists)

    def back(batches):
        for batch in batches:
            yield framed.received(batch.slice(0, 5))
            yield framed.received(batch.slice(5))

    assert framed.sent(df.coalesce(1)).mapInArrow(back, df.schema).collect() == df.coalesce(1).collect()


def test_rows_are_spread_evenly(spark, tmp_path):
    """A file of one row group and many ranges is read by one task; coding has more, of like size, and more of them for larger files."""
    from rillet.sources import framed

    path = str(tmp_path / "t")
    spark.range(0, 400_000, 1, 1).selectExpr("id", "uuid() as x").write.parquet(path)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4
        sizes = framed.spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert len(sizes) > 4 and sum(sizes) == 400_000 and max(sizes) < 2 * min(sizes)
