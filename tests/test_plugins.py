import pytest
from pyspark.sql import functions as F

from rillet.plans.adapters import events
from rillet.streaming import examples, plugins

SF = "/root/testdata/sf0.001"


def test_counter_and_restore(spark):
    e = events(spark, SF)
    first = plugins.analyse(e, examples.Counter()).cache()
    total = e.count()
    assert [r.payload for r in first.where("kind = 'message'").collect()] == [str(total)]
    assert first.where("kind = 'state'").first().processed == total
    again = plugins.analyse(e, examples.Counter(), previous=first)
    assert again.where("kind = 'message'").first().payload == str(2 * total)
    newer = examples.Counter()
    newer.version = 1
    assert plugins.analyse(e, newer, previous=first).where("kind = 'message'").first().payload == str(total)


def test_restored_state_of_joins_that_become_broadcasts(spark):
    """Each key stays in one task, whatever adaptive execution makes of tables that are thought large and turn out small."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        e = events(spark, SF).repartition(3)
        counts = {r.type: r["count"] for r in e.groupBy("type").count().collect()}
        first = plugins.analyse(e.where("type <> 'error'"), examples.Counter(), "type")
        unseen = first.where("kind = 'state'").limit(1).withColumns({"key": F.lit("zz")})
        again = plugins.analyse(e, examples.Counter(), "type", previous=first.unionByName(unseen)).where("kind = 'message'").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.key, r.payload) for r in again) == sorted((t, str(n if t == "error" else 2 * n)) for t, n in counts.items())


def test_state_text():
    state = {"n": 1, "inf": float("inf"), "t": [1, {"x": None}], "f": print}
    back = plugins.restore(plugins.preserve(state, 3), 3)
    assert back == {"n": 1, "inf": float("inf"), "t": [1, {"x": None}]} and plugins.restore(plugins.preserve(state, 3), 4) == {}
    loop, shared = {}, [1]
    loop["me"] = loop
    got = plugins.restore(plugins.preserve({"a": loop, "x": shared, "y": shared, 7: "n", 2.5: b"\xff", "s": "é"}))
    assert got["a"]["me"] is got["a"] and got["x"] is got["y"] and got[7] == "n" and got[2.5] == b"\xff" and got["s"] == "é"
    with pytest.raises(ValueError):
        plugins.preserve({print: 1})


def test_emitter():
    e = plugins.Emitter({"logger": "own", "pid": 7}, limit=10)
    e.inject_payload()
    assert e.take() == []  # nothing to say
    e.inject_payload("txt", None, 1.5, None, True, timestamp=9)
    (m,) = e.take()
    assert (m["payload"], m["type"], m["logger"], m["pid"], len(m["fields"])) == ("1.5niltrue", "inject_payload", "own", 7, 1)
    with pytest.raises(ValueError, match="output_limit"):
        e.add_to_payload("x" * 11)
    with pytest.raises(ValueError):
        e.add_to_payload()


def test_termination(spark):
    class Ends(plugins.AnalysisPlugin):
        def process_message(self, msg, state, emit):
            return 1

    with pytest.raises(Exception, match="process_message"):
        plugins.analyse(events(spark, SF), Ends()).collect()
    assert len(str(plugins.PluginTerminated("f", "x" * 999))) == 255


def test_delivery(spark):
    df = spark.range(12).withColumnRenamed("id", "offset")
    sent = plugins.deliver(df.coalesce(1), examples.Sorter()).cache()
    assert {r.outcome: r["count"] for r in sent.groupBy("outcome").count().collect()} == {"ok": 2, "fail": 4, "skip": 2, "batch": 2, "async": 2}
    assert tuple(plugins.delivery_counts(sent).first()) == (12, 4, 10)


def test_checkpoints(spark):
    """Batched messages wait for update_checkpoint() or the flush, asynchronous ones for update_checkpoint(sequence)."""

    class Late(plugins.OutputPlugin):
        def process_message(self, msg, sequence):
            if sequence == 4:
                self.update_checkpoint()
            if sequence == 9:
                self.update_checkpoint(6, failures=2)
            return plugins.BATCH if sequence % 2 else plugins.ASYNC

        def flush(self, shutdown):
            return plugins.FAIL

    sent = plugins.deliver(spark.range(12).withColumnRenamed("id", "offset").coalesce(1), Late()).cache()
    assert sorted(r.sequence for r in sent.where("acknowledged").collect()) == [0, 1, 2, 3, 4, 6]
    assert sent.count() == 12 and tuple(plugins.delivery_counts(sent).first()) == (12, 2, 6)


def test_tools():
    e = plugins.Emitter()
    raw = e.encode_message({"n": 5, "s": "x"}, type="t", severity=3, uuid=bytes(16))
    m = e.decode_message(raw)
    assert m["type"] == "t" and e.create_stream_reader().find() == (None, 0)
    for text, want in {"Type == 't' && Severity < 4": True, "Fields[n] > 5": False, "Fields[n] >= 5 && Fields[s] =~ '^x$'": True, "Fields[q] != 'x'": False, "Fields[q] == NIL": True, "Logger != 'a'": True, "Logger > 'a' || Pid < 3": True, "Hostname == NIL": True, "Type !~ '%d'": True}.items():
        assert e.create_message_matcher(text).eval(m) == want, text


def test_streams(spark, tmp_path):
    e = events(spark, SF).select("type", "timestamp", "severity")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = plugins.analyse_stream(stream, examples.Counter(), "type").writeStream.format("memory").queryName("analysed").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    out = spark.table("analysed")
    got = {r.key: r.processed for r in out.where("kind = 'state'").collect()}
    last = {r.key: (r.payload, r.type, r.severity, r.fields[1].value_string) for r in plugins.finish(out, examples.Counter()).collect()}
    assert last == {k: (str(n), "inject_payload", 7, ["count"]) for k, n in got.items()}
    assert got == {r.type: r["count"] for r in e.groupBy("type").count().collect()}
    seen = []
    q = plugins.deliver_stream(stream, lambda rows, n: seen.append((n, rows.count())), str(tmp_path / "c2"), once=True, done=lambda n: n in dict(seen))
    assert q.awaitTermination(60) and sum(n for _, n in seen) == e.count()


def test_stream_messages(spark, tmp_path):
    """A stream's injected messages have all their headers and fields."""

    class Echo(plugins.AnalysisPlugin):
        def process_message(self, msg, state, emit):
            emit.inject_message([{"name": "a", "value": [1, 2], "value_type": 2}, {"name": "b", "value": True}], type="echo", timestamp=int(msg["timestamp"]), payload="p", pid=7)

    e = events(spark, SF).select("type", "timestamp").limit(20)
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = plugins.analyse_stream(stream, Echo()).writeStream.format("memory").queryName("echoed").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    rows = spark.table("echoed").where("kind = 'message'").collect()
    assert sorted(r.timestamp for r in rows) == sorted(r.timestamp for r in e.collect())
    assert all((r.type, r.payload, r.pid, len(r.uuid), r.fields[0].value_integer, r.fields[1].value_bool) == ("echo", "p", 7, 16, [1, 2], [True]) for r in rows)


def test_input(spark, tmp_path):
    class Numbers(plugins.InputPlugin):
        def process_message(self, checkpoint):
            for k in range(checkpoint or 0, 5):
                m = plugins.message({"n": k}, timestamp=k, type="n")
                yield (m if k % 2 else plugins.encode(m)), k + 1
                yield None, k + 1

    plugins.register_input(spark, Numbers(), "numbers")
    assert spark.read.format("numbers").load().count() == 5
    q = spark.readStream.format("numbers").load().writeStream.format("memory").queryName("numbered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.timestamp for r in spark.table("numbered").collect()) == [0, 1, 2, 3, 4]
