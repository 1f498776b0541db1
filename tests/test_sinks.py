from pyspark.sql import functions as F

from rillet.schema import MESSAGE_DDL, message
from rillet.sources import sinks


def test_payload_files(spark, tmp_path):
    rows = [message({"payload_name": "a/b", "payload_type": "csv"}, uuid=bytes(16), logger="l-1", payload="x,y"), message(uuid=bytes(16), payload="z"), message(uuid=bytes(16))]
    sinks.payload_files(spark.createDataFrame(rows, MESSAGE_DDL), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted((r.name, r.value) for r in got) == [("..txt", "z"), ("l_1.a_b.csv", "x,y")]


def test_database_columns(spark):
    rows = [message({"n": 7}, uuid=bytes(16), timestamp=1_500_000_000, payload="p" * 30, type=None)]
    df = spark.createDataFrame(rows, MESSAGE_DDL)
    out = sinks.database_columns(df, {"at": ("Timestamp", "double", None), "t": ("Timestamp", "timestamp", None), "p": ("Payload", "string", 12), "n": ("Fields[n]", "double", None), "kind": ("Type", "string", 5)})
    assert tuple(out.select("at", "p", "n", "kind", F.unix_micros("t")).first()) == (1.5, "TRUNCATED:pp", 7.0, None, 1_500_000)
