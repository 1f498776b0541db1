"""Every registered query of the engine, with its SQL where SQL can express it."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.functions import scalar as fn
from rillet.operators import accessors, cat, routing, stats
from rillet.operators.matcher import matched, matcher
from rillet.plans.adapters import EVENTS_SQL, FLAT, document_messages, event_messages, events, order_messages
from rillet.schema import BOOL, DOUBLE, INTEGER
from rillet.scratch import shared_dir
from rillet.sources import framed
from rillet.streaming import examples, plugins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe errors by logger, with statistics of their values."""
    found = events(spark, sf_dir).where(matcher("Type == 'error' && Severity <= 3 || Type =~ '^purch' && Fields[value] > 100", FLAT))
    return found.groupBy("type").agg(F.count("*").alias("n"), F.round(stats.running_mean(F.col("f_value")), 6).alias("mean"))


query("flagship", f"WITH {EVENTS_SQL} SELECT type, count(*) AS n, round(avg(value), 6) AS mean FROM m WHERE type = 'error' AND severity <= 3 OR starts_with(type, 'purch') AND value > 100 GROUP BY type")(flagship)

#: name: expression and its SQL condition; each runs over all events, flat and, where it reads fields, nested.
MATCHES = {
    "true": ("TRUE", "TRUE"),
    "false": ("FALSE", "FALSE"),
    "type_eq": ("Type == 'error'", "type = 'error'"),
    "logger_ne_nil_true": ("Logger != 'svc-1'", "logger IS NULL OR logger <> 'svc-1'"),
    "logger_lt": ("Logger < 'svc-3'", "logger IS NULL OR logger < 'svc-3'"),
    "logger_le": ("Logger <= 'svc-3'", "logger IS NULL OR logger <= 'svc-3'"),
    "logger_gt": ("Logger > 'svc-2'", "logger > 'svc-2'"),
    "logger_ge": ("Logger >= 'svc-2'", "logger >= 'svc-2'"),
    "payload_literal": ("Payload =~ '\"k\": 6'", "contains(payload, '\"k\": 6')"),
    "payload_literal_mod": ("Payload =~ '{\"k\": 1'%", "contains(payload, '{\"k\": 1')"),
    "payload_pattern": ("Payload =~ 'k\": %d+5}$'", "regexp_matches(payload, 'k\": [0-9]+5}$')"),
    "payload_not_pattern": ("Payload !~ 'k\": %d+5}$'", "NOT regexp_matches(payload, 'k\": [0-9]+5}$')"),
    "payload_balanced": ("Payload =~ '^%b{}$'", "regexp_matches(payload, '^[{][^{}]*[}]$')"),
    "payload_lazy": ("Payload =~ ':.-5'", "regexp_matches(payload, ':.*5')"),
    "anchor_start": ("Type =~ '^si'", "starts_with(type, 'si')"),
    "anchor_end": ("Type =~ 'up$'", "ends_with(type, 'up')"),
    "class_set": ("Type =~ '^[ev]'", "regexp_matches(type, '^[ev]')"),
    "class_complement": ("Logger !~ '[^svc%-1-3]'", "logger IS NULL OR NOT regexp_matches(logger, '[^svc1-3-]')"),
    "frontier": ("Payload =~ '%f[%d]6'", "regexp_matches(payload, '(^|[^0-9])6')"),
    "pattern_never": ("Type =~ 'e%'", "FALSE"),
    "ts_rfc3339": ("Timestamp >= '2024-01-15T12:30:00Z'", "CAST(ts_ns AS DOUBLE) >= 1705321800e9"),
    "ts_offset": ("Timestamp < '2024-01-15T12:30:00-0700'", "CAST(ts_ns AS DOUBLE) < 1705347000e9"),
    "ts_ns": ("Timestamp >= 1.7053e18", "CAST(ts_ns AS DOUBLE) >= 1.7053e18"),
    "severity": ("Severity <= 6", "severity <= 6"),
    "severity_fraction": ("Severity > 3.5", "severity > 3.5"),
    "pid_absent": ("Pid < 3", "coalesce(pid, -2147483648) < 3"),
    "pid_ge": ("Pid >= 3", "coalesce(pid, -2147483648) >= 3"),
    "pid_nil": ("Pid == NIL", "pid IS NULL"),
    "nil": ("Logger == NIL", "logger IS NULL"),
    "not_nil": ("Logger != NIL", "logger IS NOT NULL"),
    "hostname_missing": ("Hostname != 'a' && Hostname !~ 'b'", "TRUE"),
    "uuid_gt": ("Uuid > 'a'", "uuid > 'a'::BLOB"),
    "field_num": ("Fields[value] > 50", "value > 50"),
    "field_int": ("Fields[user_id] == 42 || Fields[k] != 7", "user_id = 42 OR k <> 7"),
    "field_true": ("Fields[even] == TRUE", "even"),
    "field_false": ("Fields[even] != TRUE", "NOT even"),
    "field_is_false": ("Fields[even] == FALSE", "NOT even"),
    "payload_balanced_inside": ("Payload =~ '%b{}' && Payload =~ '\":%s*%f[%d]%d+%b{}$' || Payload =~ '^%b{}$' && Fields[k] > 90", "k > 90"),
    "field_exists": ("Fields[k] != NIL", "k IS NOT NULL"),
    "field_missing": ("Fields[missing] != 'x'", "FALSE"),
    "field_missing_nil": ("Fields[missing] == NIL", "TRUE"),
    "field_mismatch": ("Fields[value] != 'text'", "FALSE"),
    "field_index": ("Fields[value][1] == NIL && Fields[value][0][0] != NIL", "TRUE"),
    "and_or_prec": ("Type == 'error' || Type == 'view' && Pid < 3", "type = 'error' OR type = 'view' AND coalesce(pid, -2147483648) < 3"),
    "paren": ("(Type == 'error' || Type == 'view') && Pid < 3", "(type = 'error' OR type = 'view') AND coalesce(pid, -2147483648) < 3"),
}


def _match(expression: str, nested: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if nested:
            return event_messages(spark, sf_dir).where(matcher(expression)).select("event_id", "type")
        return events(spark, sf_dir).where(matcher(expression, FLAT)).select("event_id", "type")

    return run


for _name, (_expression, _sql) in MATCHES.items():
    _select = f"WITH {EVENTS_SQL} SELECT event_id, type FROM m WHERE {_sql}"
    query(f"match_{_name}", _select)(_match(_expression, False))
    if "Fields" in _expression:
        query(f"match_nested_{_name}", _select)(_match(_expression, True))


@query("match_projected", f"WITH {EVENTS_SQL} SELECT event_id, coalesce(logger > 'svc-2', FALSE) AS late, logger IS NULL OR logger < 'svc-2' AS early FROM m")
def match_projected(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", matched("Logger > 'svc-2'", FLAT).alias("late"), matched("Logger < 'svc-2'", FLAT).alias("early"))


@query("match_documents", "SELECT doc_id FROM documents WHERE contains(text, 'License') OR lang = 'de' AND n_chars > 5000")
def match_documents(spark, sf_dir):
    return document_messages(spark, sf_dir).where(matcher("Payload =~ 'License' || EnvVersion == 'de' && Fields[n_chars] > 5000")).select("doc_id")


@query("match_orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice >= 150000 AND epoch_us(o_orderdate) * 1000 < 800000000000000000")
def match_orders(spark, sf_dir):
    return order_messages(spark, sf_dir).where(matcher("Logger != '1-URGENT' && Fields[totalprice] >= 150000 && Timestamp < 8e17")).select("o_orderkey")


@query("cat_count", f"WITH {EVENTS_SQL} SELECT count(*) AS processed, count(*) FILTER (WHERE type = 'error') AS matched FROM m")
def cat_count(spark, sf_dir):
    return stats.match_counts(events(spark, sf_dir), matcher("Type == 'error'", FLAT))


@query("cat_tail", f"WITH {EVENTS_SQL} SELECT event_id, type FROM (SELECT * FROM m ORDER BY event_id DESC LIMIT 100) WHERE severity < 7")
def cat_tail(spark, sf_dir):
    return cat.select(events(spark, sf_dir), "Severity < 7", 100, "event_id").select("event_id", "type")


@query("project_headers", f"WITH {EVENTS_SQL} SELECT event_id, hex(uuid) AS uuid, ts_ns, type, logger, severity, payload, pid FROM m")
def project_headers(spark, sf_dir):
    read = accessors.read_message
    return event_messages(spark, sf_dir).select("event_id", F.hex(read("Uuid")).alias("uuid"), read("Timestamp").alias("ts_ns"), read("Type").alias("type"), read("Logger").alias("logger"), read("Severity").alias("severity"), read("Payload").alias("payload"), read("Pid").alias("pid"))


@query("project_field_index", f"WITH {EVENTS_SQL} SELECT event_id, value, user_id, CAST(NULL AS DOUBLE) AS beyond, even FROM m")
def project_field_index(spark, sf_dir):
    read = accessors.read_message
    return event_messages(spark, sf_dir).select("event_id", read("Fields[value]", 0, 0, DOUBLE).alias("value"), read("Fields[user_id]", kind=INTEGER).alias("user_id"), read("Fields[value]", 1, 0, DOUBLE).alias("beyond"), read("Fields[even]", kind=BOOL).alias("even"))


@query("explode_fields", f"""WITH {EVENTS_SQL} SELECT event_id, CAST(position AS INTEGER) AS position, name, CAST(value_type AS INTEGER) AS value_type FROM m,
  (VALUES (0, 'value', 3), (1, 'user_id', 2), (2, 'k', 2), (3, 'even', 4)) f(position, name, value_type)""")
def explode_fields(spark, sf_dir):
    return accessors.explode_fields(event_messages(spark, sf_dir), "event_id").select("event_id", "position", "name", "value_type")


@query("header_defaults", f"WITH {EVENTS_SQL} SELECT event_id, coalesce(logger, 'cfg') AS logger, coalesce(pid, 99) AS pid, coalesce(hostname, 'host') AS hostname FROM m")
def header_defaults(spark, sf_dir):
    return accessors.header_defaults(events(spark, sf_dir), {"logger": "cfg", "pid": 99, "hostname": "host"}).select("event_id", "logger", "pid", "hostname")


@query("restricted_headers", f"WITH {EVENTS_SQL} SELECT event_id, 'cfg' AS logger, 99 AS pid, 'host' AS hostname, type FROM m")
def restricted_headers(spark, sf_dir):
    return accessors.restricted_headers(events(spark, sf_dir), {"logger": "cfg", "pid": 99, "hostname": "host"}).select("event_id", "logger", "pid", "hostname", "type")


@query("running_stats_by_type", f"WITH {EVENTS_SQL} SELECT type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM m GROUP BY type")
def running_stats_by_type(spark, sf_dir):
    v = F.col("f_value")
    return events(spark, sf_dir).groupBy("type").agg(stats.running_count(v).alias("n"), F.round(stats.running_mean(v), 6).alias("mean"), F.round(stats.running_sd(v), 6).alias("sd"))


@query("plugin_stats", f"""WITH {EVENTS_SQL} SELECT type AS plugin, count(*) AS im_cnt, CAST(sum(strlen(payload)) AS BIGINT) AS im_bytes, count(*) FILTER (WHERE user_id % 4 <> 3) AS pm_cnt,
  count(*) FILTER (WHERE user_id % 4 = 1) AS pm_failures, round(avg(value), 6) AS pm_avg, round(stddev_samp(value), 6) AS pm_sd, CAST(max(strlen(payload)) AS INTEGER) AS out_max FROM m GROUP BY type""")
def plugin_stats(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("type").alias("plugin"), (-(F.col("f_user_id") % 4)).alias("rv"), F.col("f_value").alias("seconds"), F.lit(1).alias("messages"), F.octet_length("payload").alias("bytes"))
    out = stats.plugin_stats(calls, output_plugin=True)
    return out.withColumns({"pm_avg": F.round("pm_avg", 6), "pm_sd": F.round("pm_sd", 6)})


@query("counter_plugin", f"WITH {EVENTS_SQL} SELECT type AS key, CAST(count(*) AS VARCHAR) AS payload FROM m GROUP BY type")
def counter_plugin(spark, sf_dir):
    return plugins.analyse(events(spark, sf_dir), examples.Counter(), "type").where("kind = 'message'").select("key", "payload")


@query("counter_builtin", f"WITH {EVENTS_SQL} SELECT type, count(*) AS n FROM m GROUP BY type")
def counter_builtin(spark, sf_dir):
    return events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("state_restore", f"WITH {EVENTS_SQL} SELECT type AS key, CAST(2 * count(*) AS VARCHAR) AS payload FROM m GROUP BY type")
def state_restore(spark, sf_dir):
    first = plugins.analyse(events(spark, sf_dir), examples.Counter(), "type")
    return plugins.analyse(events(spark, sf_dir), examples.Counter(), "type", previous=first).where("kind = 'message'").select("key", "payload")


@query("output_return_codes", """SELECT outcome, count(*) AS n, max(attempts) AS attempts FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' WHEN 2 THEN 'skip' WHEN 3 THEN 'fail'
  WHEN 4 THEN 'batch' ELSE 'async' END AS outcome, CASE event_id % 6 WHEN 3 THEN 4 ELSE 1 END AS attempts FROM events) GROUP BY outcome""")
def output_return_codes(spark, sf_dir):
    sent = plugins.deliver(events(spark, sf_dir).select("event_id", "type"), examples.Sorter(), "event_id")
    return sent.groupBy("outcome").agg(F.count("*").alias("n"), F.max("attempts").alias("attempts"))


@query("inject_payload_shape", f"""WITH {EVENTS_SQL} SELECT 'inject_payload' AS type, type || ':' || count(*) AS payload, 2 AS n_fields FROM m GROUP BY m.type""")
def inject_payload_shape(spark, sf_dir):
    counted = events(spark, sf_dir).groupBy("type").agg(F.concat("type", F.lit(":"), F.count("*").cast("string")).alias("text"))
    out = counted.select(*accessors.inject_payload(F.col("text"), "txt", "counts"))
    return out.select("type", "payload", F.size("fields").alias("n_fields"))


@query("payload_filename", f"WITH {EVENTS_SQL} SELECT DISTINCT regexp_replace(coalesce(logger, ''), '[^A-Za-z0-9]', '_', 'g') || '.' || regexp_replace(type || '/x', '[^A-Za-z0-9]', '_', 'g') || '.txt' AS name FROM m")
def payload_filename(spark, sf_dir):
    return events(spark, sf_dir).select(accessors.payload_filename(F.col("logger"), F.concat("type", F.lit("/x")), F.lit("txt")).alias("name")).distinct()


@query("codec_roundtrip", f"WITH {EVENTS_SQL} SELECT event_id, hex(uuid) AS uuid, ts_ns AS timestamp, type, logger, severity, payload, pid, value, user_id, k, even FROM m")
def codec_roundtrip(spark, sf_dir):
    packed = framed.encoded(event_messages(spark, sf_dir)).select("event_id", "pb")
    back = framed.decoded(packed, "pb", True, ["event_id"])
    read = accessors.read_message
    return back.select("event_id", F.hex("uuid").alias("uuid"), "timestamp", "type", "logger", "severity", "payload", "pid", read("Fields[value]", kind=DOUBLE).alias("value"), read("Fields[user_id]", kind=INTEGER).alias("user_id"), read("Fields[k]", kind=INTEGER).alias("k"), read("Fields[even]", kind=BOOL).alias("even"))


@query("frame_scan_resync", f"WITH {EVENTS_SQL} SELECT hex(uuid) AS uuid, type, CASE WHEN k IS NULL THEN 3 ELSE 3 END AS discarded FROM m")
def frame_scan_resync(spark, sf_dir):
    """Each frame follows three bytes of noise, one of them a false start."""
    packed = framed.encoded(event_messages(spark, sf_dir), framed=True)
    noisy = packed.select(F.concat(F.lit(bytearray(b"x\x1e\x00")), "pb", F.lit(bytearray(b"yy"))).alias("chunk"))
    return framed.frames_of(noisy).select(F.hex("uuid").alias("uuid"), "type", F.col("discarded").cast("int").alias("discarded"))


def _written(spark, sf_dir, ordered: bool = False) -> str:
    """Events as framed files in a folder of their own; ordered ones follow one another by path and offset."""
    framed.register(spark)
    path = shared_dir(spark)
    messages = event_messages(spark, sf_dir)
    if ordered:
        messages = messages.repartitionByRange(framed.parts(messages), "event_id").sortWithinPartitions("event_id")
    packed = framed.encoded(messages, name="raw")
    packed.select("raw").write.format("framed").mode("append").save(path)
    return path


@query("framed_write_read", f"WITH {EVENTS_SQL} SELECT hex(uuid) AS uuid, ts_ns AS timestamp, type, logger, severity, payload, pid, value, k FROM m")
def framed_write_read(spark, sf_dir):
    """Files are written, found again, and read in ranges that begin inside of frames."""
    back = spark.read.format("framed").option("split", str(1 << 18)).load(_written(spark, sf_dir))
    read = accessors.read_message
    return back.select(F.hex("uuid").alias("uuid"), "timestamp", "type", "logger", "severity", "payload", "pid", read("Fields[value]", kind=DOUBLE).alias("value"), read("Fields[k]", kind=INTEGER).alias("k"))


@query("framed_count", f"WITH {EVENTS_SQL} SELECT count(*) AS processed, count(*) FILTER (WHERE type = 'error' AND value > 50) AS matched, CAST(0 AS BIGINT) AS discarded FROM m")
def framed_count(spark, sf_dir):
    path = _written(spark, sf_dir)
    return cat.counts(cat.load(spark, path), path, "Type == 'error' && Fields[value] > 50")


@query("framed_tail", f"WITH {EVENTS_SQL} SELECT hex(uuid) AS uuid, type FROM (SELECT * FROM m ORDER BY event_id DESC LIMIT 100) WHERE severity < 7")
def framed_tail(spark, sf_dir):
    return cat.select(cat.load(spark, _written(spark, sf_dir, True)), "Severity < 7", 100).select(F.hex("uuid").alias("uuid"), "type")


@query("framed_follow", f"WITH {EVENTS_SQL} SELECT type, count(*) AS n FROM m WHERE severity < 7 GROUP BY type")
def framed_follow(spark, sf_dir):
    """A stream over the files, run until it has what is there."""
    out = shared_dir(spark)
    stream = cat.follow(spark, _written(spark, sf_dir), "Severity < 7").select("type")
    cat.followed(stream, lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}"), f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("type string").parquet(f"{out}/rows").groupBy("type").agg(F.count("*").alias("n"))


@query("decode_errors", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'missing Uuid' WHEN 1 THEN 'tag:30 wiretype:0 position:0' ELSE 'tag:1 wiretype:2 position:0' END AS error FROM events""")
def decode_errors(spark, sf_dir):
    kinds = F.when(F.col("event_id") % 3 == 0, F.lit(bytearray(b"\x10\x01"))).when(F.col("event_id") % 3 == 1, F.lit(bytearray(b"\xf0"))).otherwise(F.lit(bytearray(b"\x0a\x01\xff")))
    return framed.decoded(events(spark, sf_dir).select("event_id", kinds.alias("pb")), "pb", False, ["event_id"]).select("event_id", "error")


@query("encode_uuid", "SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS uuid FROM events")
def encode_uuid(spark, sf_dir):
    """Text of 36 characters becomes 16 raw bytes, the first part of each encoded message."""
    text = F.concat_ws("-", *[F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    packed = framed.encoded(event_messages(spark, sf_dir).withColumn("uuid", text)).select("event_id", "pb")
    return packed.select("event_id", F.lower(F.hex(F.substring("pb", 3, 16))).alias("uuid"))


def _varint_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END)"


@query("message_size", f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, 28 + 2 + strlen(type) + coalesce(2 + strlen(logger), 0) + 2 + 1 + {_varint_sql('strlen(payload)')} + strlen(payload) + coalesce(pid - pid + 2, 0)
    + 27 + 14 + {_varint_sql('user_id')} + 8 + {_varint_sql('k')} + 12 AS size FROM m)
  SELECT event_id, CAST(size AS BIGINT) AS size, CAST(size + 4 + {_varint_sql('size')} AS BIGINT) AS framed FROM s""")
def message_size(spark, sf_dir):
    raw = framed.encoded(event_messages(spark, sf_dir), name="raw")
    return raw.select("event_id", accessors.read_message("size").alias("size"), F.octet_length(accessors.read_message("framed")).cast("long").alias("framed"))


@query("text_view", f"""WITH {EVENTS_SQL}, u AS (SELECT *, lower(hex(uuid)) AS h, make_timestamp(ts_ns // 1000) AS moment FROM m)
  SELECT event_id, ':Uuid: ' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || chr(10) || ':Timestamp: ' || strftime(moment, '%Y-%m-%dT%H:%M:%S.') || printf('%09d', ts_ns % 1000000000) || 'Z' || chr(10)
    || ':Type: ' || type || chr(10) || ':Logger: ' || coalesce(logger, '<nil>') || chr(10) || ':Severity: ' || severity || chr(10) || ':Payload: ' || payload || chr(10) || ':EnvVersion: <nil>' || chr(10)
    || ':Pid: ' || coalesce(CAST(pid AS VARCHAR), '<nil>') || chr(10) || ':Hostname: <nil>' || chr(10) || ':Fields:' || chr(10)
    || '    | name: value type: 3 representation: units value: ' || printf('%.17g', value) || chr(10) || '    | name: user_id type: 2 representation: <nil> value: ' || user_id || chr(10)
    || '    | name: k type: 2 representation: <nil> value: ' || k || chr(10) || '    | name: even type: 4 representation: <nil> value: ' || CASE WHEN even THEN 'true' ELSE 'false' END || chr(10) || chr(10) AS text FROM u""")
def text_view(spark, sf_dir):
    return cat.text(event_messages(spark, sf_dir), "event_id")


def _price():
    return F.col("l_extendedprice")


def _places(found):
    return F.concat_ws(":", found["first"].cast("string"), found["last"].cast("string"), F.concat_ws(",", found["captures"]))


_STRINGS = {
    "len": (lambda: fn.length(F.col("p_name")), "CAST(strlen(p_name) AS INTEGER)"),
    "sub": (lambda: fn.sub(F.col("p_name"), 2, 4), "substring(p_name, 2, 3)"),
    "sub_end": (lambda: fn.sub(F.col("p_name"), -3), "right(p_name, 3)"),
    "upper": (lambda: fn.upper(F.col("p_name")), "upper(p_name)"),
    "lower": (lambda: fn.lower(F.col("p_brand")), "lower(p_brand)"),
    "rep": (lambda: fn.rep(F.col("p_brand"), 3), "repeat(p_brand, 3)"),
    "reverse": (lambda: fn.reverse(F.col("p_name")), "reverse(p_name)"),
    "byte": (lambda: fn.byte(F.col("p_name"), 1), "ascii(p_name)"),
    "char": (lambda: fn.char(F.col("p_size") + 48).cast("string"), "chr(p_size + 48)"),
    "find": (lambda: fn.find_plain(F.col("p_name"), "1"), "nullif(strpos(p_name, '1'), 0)::INTEGER"),
    "match": (lambda: fn.match(F.col("p_name"), "(%d+)$"), "nullif(regexp_extract(p_name, '([0-9]+)$', 1), '')"),
    "gmatch": (lambda: fn.concat(fn.gmatch(F.col("p_type"), "%a+"), "|"), "array_to_string(regexp_extract_all(p_type, '[A-Za-z]+'), '|')"),
    "gsub": (lambda: fn.gsub(F.col("p_brand"), "(%a+)(%W*)", "<%1>%2"), r"regexp_replace(p_brand, '([A-Za-z]+)([^A-Za-z0-9]*)', '<\1>\2', 'g')"),
    "gsub_count": (lambda: fn.gsub_count(F.col("p_name"), "%d"), "CAST(len(regexp_extract_all(p_name, '[0-9]')) AS INTEGER)"),
    "gsub_table": (lambda: fn.gsub_table(F.col("p_type"), "%a+", {"STEEL": "iron"}), "regexp_replace(p_type, 'STEEL', 'iron', 'g')"),
    "format": (lambda: fn.format("%05d|%-8s|%.2f|%x", F.col("p_size"), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size")), "printf('%05d|%-8s|%.2f|%x', p_size, p_brand, p_retailprice, p_size)"),
    "reverse_bytes": (lambda: F.hex(fn.reverse(F.concat(F.lit("é"), "p_brand"))), "hex(encode(reverse(p_brand))) || 'A9C3'"),
    "byte_range": (lambda: F.array_join(fn.byte_range(F.concat(F.lit("é"), "p_brand"), 1, 3).cast("array<string>"), ","), "'195,169,' || ascii(p_brand)"),
    "find_pattern": (lambda: fn.concat(fn.find(F.nullif("p_type", F.lit("X")), " (%a+)", 2)["captures"], "|"), "string_split(p_type, ' ')[2]"),
    "find_places": (lambda: _places(fn.find(F.concat(F.lit("ñ "), "p_type"), "()%a+()")), "'4:' || (3 + strlen(string_split(p_type, ' ')[1])) || ':4,' || (4 + strlen(string_split(p_type, ' ')[1]))"),
    "find_null": (lambda: fn.find(F.when(F.col("p_size") > 25, F.col("p_name")), "%d+$")["first"], "CASE WHEN p_size > 25 AND regexp_matches(p_name, '[0-9]$') THEN CAST(strlen(p_name) - strlen(regexp_extract(p_name, '[0-9]+$')) + 1 AS INTEGER) END"),
    "match_balanced": (lambda: fn.match(F.concat(F.lit("f("), "p_name", F.lit("(x))g)")), "%b()"), "'(' || p_name || '(x))'"),
    "match_init": (lambda: fn.match(F.col("p_type"), "%a+", init=3), "regexp_extract(substring(p_type, 3), '[A-Za-z]+')"),
    "gsub_limit": (lambda: fn.gsub(F.col("p_type"), "%a+", "<%0>", 1), r"regexp_replace(p_type, '([A-Za-z]+)', '<\1>')"),
    "gsub_function": (lambda: fn.gsub(F.concat(F.lit("é="), "p_size", F.lit(";")), "%d+", lambda d: int(d) * 2), "'é=' || p_size * 2 || ';'"),
    "gmatch_pairs": (lambda: F.array_join(F.transform(fn.gmatch_all(F.col("p_type"), "(%a)(%a*)"), lambda m: F.concat_ws("-", m)), " "), r"regexp_replace(p_type, '([A-Za-z])([A-Za-z]*)', '\1-\2', 'g')"),
    "format_null": (lambda: fn.format("%05d|%s", F.nullif("p_size", F.lit(1)), F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))), "CASE WHEN p_size <> 1 AND p_size % 3 > 0 THEN printf('%05d|%s', p_size, p_brand) END"),
    "format_long": (lambda: fn.format("%d", F.lit(2**53 + 1) + F.col("p_size").cast("long")), "CAST(9007199254740993 + p_size AS VARCHAR)"),
    "sort_less": (lambda: fn.concat(fn.sort(F.split("p_type", " "), less=lambda x, y: x > y), ","), "array_to_string(list_reverse_sort(string_split(p_type, ' ')), ',')"),
    "escape": (lambda: fn.escape_binary(F.concat("p_brand", F.lit('"\\'))), "p_brand || '\\\"\\\\'"),
}
_MATHS = {
    **{n: (lambda n=n: fn.math_function(n, F.col("l_discount")), f"{n}(l_discount)") for n in ("abs", "acos", "asin", "atan", "cos", "cosh", "exp", "sin", "sinh", "sqrt", "tan", "tanh")},
    "ceil": (lambda: fn.math_function("ceil", _price()), "ceil(l_extendedprice)"), "floor": (lambda: fn.math_function("floor", _price()), "floor(l_extendedprice)"),
    "deg": (lambda: fn.math_function("deg", F.col("l_tax")), "degrees(l_tax)"), "rad": (lambda: fn.math_function("rad", _price()), "radians(l_extendedprice)"),
    "log": (lambda: fn.math_function("log", _price()), "ln(l_extendedprice)"), "log10": (lambda: fn.math_function("log10", _price()), "log10(l_extendedprice)"),
    "log_edge": (lambda: F.when(fn.math_function("log", F.col("l_discount")) == float("-inf"), 1).otherwise(0), "CASE WHEN l_discount = 0 THEN 1 ELSE 0 END"),
    "atan2": (lambda: fn.atan2(_price(), F.col("l_quantity")), "atan2(l_extendedprice, l_quantity)"), "pow": (lambda: fn.pow(F.col("l_quantity"), F.col("l_tax")), "pow(l_quantity, l_tax)"),
    "fmod": (lambda: fn.fmod(-_price(), F.col("l_quantity")) + 0.0, "-fmod(l_extendedprice, l_quantity) + 0.0::DOUBLE"), "mod": (lambda: fn.mod(-F.col("l_quantity"), F.lit(7.0)), "-l_quantity - floor(-l_quantity / 7.0::DOUBLE) * 7.0::DOUBLE"),
    "divide_zero": (lambda: F.when(fn.divide(F.col("l_quantity"), F.col("l_discount")) == float("inf"), 1).otherwise(0), "CASE WHEN l_discount = 0 THEN 1 ELSE 0 END"),
    "modf": (lambda: fn.modf(_price())["fraction"], "l_extendedprice - trunc(l_extendedprice)"), "ldexp": (lambda: fn.ldexp(_price(), F.lit(3)), "l_extendedprice * 8"),
    "frexp": (lambda: fn.frexp(_price())["exponent"], "CAST(floor(log2(l_extendedprice)) + 1 AS INTEGER)"),
    "max": (lambda: stats.greatest(F.col("l_tax"), F.col("l_discount")), "greatest(l_tax, l_discount)"), "min": (lambda: stats.least(F.col("l_tax"), F.col("l_discount")), "least(l_tax, l_discount)"),
    "lp2_large": (lambda: fn.next_power_of_two(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber").cast("int") * 8 - 1)), "CAST(1 AS BIGINT) << CAST(l_linenumber * 8 - 1 AS INTEGER)"),
    "lp2_null": (lambda: fn.next_power_of_two(F.nullif(F.col("l_quantity").cast("long"), F.lit(5))), "CASE WHEN l_quantity <> 5 THEN CAST(pow(2, ceil(log2(l_quantity))) AS BIGINT) END"),
    "frexp_null": (lambda: fn.frexp(F.nullif(F.col("l_quantity").cast("double"), F.lit(1.0)))["exponent"], "CASE WHEN l_quantity <> 1 THEN CAST(floor(log2(l_quantity)) + 1 AS INTEGER) END"),
    "huge_pi": (lambda: F.when(fn.huge() > _price(), fn.pi() * F.col("l_tax")), "pi() * l_tax"),
    "lp2": (lambda: fn.next_power_of_two(F.col("l_quantity").cast("long")), "CAST(pow(2, ceil(log2(l_quantity))) AS BIGINT)"),
}


def _columns(table: str, keys: list[str], part: str, columns: dict, digits: int | None = None):
    for name, (column, sql) in columns.items():
        rounded = digits is not None and name not in ("log_edge", "divide_zero", "frexp", "frexp_null", "lp2", "lp2_large", "lp2_null")
        value = (lambda column=column: F.round(column(), digits)) if rounded else column
        text = f"SELECT {', '.join(keys)}, {f'round({sql}, {digits})' if rounded else sql} AS value FROM {table}"
        query(f"{part}_{name}", text)(lambda spark, sf_dir, value=value: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, value().alias("value")))


_columns("part", ["p_partkey"], "str", _STRINGS)
_columns("lineitem", ["l_orderkey", "l_linenumber"], "math", _MATHS, 6)


_SERIES = "1.1283791670955126 * (x - x * x * x / 3 + x * x * x * x * x / 10 - pow(x, 7) / 42 + pow(x, 9) / 216)"


@query("math_erf", f"SELECT l_orderkey, l_linenumber, round({_SERIES}, 9) AS erf, round(1 - {_SERIES}, 9) AS erfc FROM (SELECT *, l_discount AS x FROM lineitem)")
def math_erf(spark, sf_dir):
    """Discounts are small, where a few terms of the series are the function."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.round(fn.erf(F.col("l_discount")), 9).alias("erf"), F.round(fn.erfc(F.col("l_discount")), 9).alias("erfc"))


@query("number_text", "SELECT l_orderkey, l_linenumber, rtrim(rtrim(printf('%.8f', x), '0'), '.') AS output, printf('%.14g', x) AS tostring FROM (SELECT *, l_extendedprice / 7 AS x FROM lineitem)")
def number_text(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", fn.number_text(F.col("l_extendedprice") / 7).alias("output"), fn.tostring(F.col("l_extendedprice") / 7).alias("tostring"))


def _seconds():
    return F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000")



@query("date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d at %H.%M.%S') AS iso, strftime(o_orderdate, 'day %j of %y, %b') AS words FROM orders")
def date_format(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fn.date("!%Y/%m/%d at %H.%M.%S", _seconds()).alias("iso"), fn.date("day %j of %y, %b", _seconds()).alias("words"))


@query("date_words", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 1 THEN strftime(o_orderdate, '%d') || ' apples upper ' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || ', it''s %' END AS literals,
  strftime(o_orderdate, '%U %W %V %u %w %G') AS weeks FROM orders""")
def date_words(spark, sf_dir):
    known = F.when(F.col("o_orderkey") % 7 != 1, _seconds())
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fn.date("%d apples upper %e, it's %%", known).alias("literals"), fn.date("%U %W %V %u %w %G", _seconds()).alias("weeks"))


@query("date_table", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS wday, CAST(dayofyear(o_orderdate) AS INTEGER) AS yday FROM orders")
def date_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fn.date_table(_seconds()).alias("t")).select("o_orderkey", "t.year", "t.month", "t.wday", "t.yday")


@query("date_time", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) + 12 * 3600 AS BIGINT) AS noon FROM orders")
def date_time(spark, sf_dir):
    t = fn.date_table(_seconds())
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fn.time(t["year"], t["month"], t["day"]).alias("noon"))


@query("table_functions", """SELECT p_partkey, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS sorted, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n,
  array_to_string(list_append(string_split(p_type, ' '), 'x'), '-') AS inserted, array_to_string(list_slice(string_split(p_type, ' '), 1, -2), '-') AS removed FROM part""")
def table_functions(spark, sf_dir):
    t = F.split("p_type", " ")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fn.concat(fn.sort(t), ",").alias("sorted"), F.size(t).alias("n"), fn.concat(fn.insert(t, F.lit("x")), "-").alias("inserted"), fn.concat(fn.remove(t), "-").alias("removed"))


@query("tonumber", "SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS plain, CAST(NULL AS DOUBLE) AS name FROM part")
def tonumber(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fn.tonumber(F.col("p_size").cast("string")).alias("plain"), fn.tonumber(F.concat(F.lit("x"), "p_name")).alias("name"))


@query("lookup_enrichment", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_enrichment(spark, sf_dir):
    """Enrichment by a lookup table; Spark broadcasts it where its size allows."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("fan_out", f"""WITH {EVENTS_SQL} SELECT event_id, 'errors' AS rule FROM m WHERE type = 'error' UNION ALL SELECT event_id, 'early' FROM m WHERE pid IS NULL OR pid < 2
  UNION ALL SELECT event_id, 'large' FROM m WHERE value > 60""")
def fan_out(spark, sf_dir):
    """Every message to each rule that it passes."""
    return routing.fan_out(events(spark, sf_dir), {"errors": "Type == 'error'", "early": "Pid < 2", "large": "Fields[value] > 60"}, FLAT).select("event_id", "rule")


@query("enrich_messages", f"WITH {EVENTS_SQL} SELECT event_id, n_name AS nation, r_name AS region FROM m LEFT JOIN nation ON user_id % 30 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_messages(spark, sf_dir):
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    known = routing.enrich(events(spark, sf_dir), nation, F.col("f_user_id") % 30, {"nation": "n_name", "region_key": "n_regionkey"}, "n_nationkey")
    return routing.enrich(known, region, F.col("region_key"), {"region": "r_name"}, "r_regionkey").select("event_id", "nation", "region")


@query("timer_stats", f"WITH {EVENTS_SQL} SELECT type AS plugin, count(*) FILTER (WHERE NOT even) AS pm_cnt, round(avg(value) FILTER (WHERE NOT even), 6) AS pm_avg, round(avg(value) FILTER (WHERE even), 6) AS te_avg, round(coalesce(stddev_samp(value) FILTER (WHERE even), 0), 6) AS te_sd FROM m GROUP BY type")
def timer_stats(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("type").alias("plugin"), F.lit(0).alias("rv"), F.col("f_value").alias("seconds"), F.lit(1).alias("messages"), F.lit(0).alias("bytes"), F.col("f_even").alias("timer"))
    return stats.plugin_stats(calls).select("plugin", "pm_cnt", *[F.round(c, 6).alias(c) for c in ("pm_avg", "te_avg", "te_sd")])


@query("event_windows", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: event-time windows over messages."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("day"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
