"""The driver's tables as message streams, in flat and nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.operators.matcher import Flat
from rillet.schema import BOOL, DOUBLE, FIELD_DDL, HEADERS, INTEGER, field, one

EVENT_FIELDS = {"value": ("f_value", DOUBLE), "user_id": ("f_user_id", INTEGER), "k": ("f_k", INTEGER), "even": ("f_even", BOOL)}
FLAT = Flat(EVENT_FIELDS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with headers and fields as flat columns; storage prunes and filters those it holds as they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("uuid"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.col("event_type").alias("type"),
        F.nullif(F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")), F.lit("svc-0")).alias("logger"),
        F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 6).otherwise(7).alias("severity"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("env_version"),
        F.nullif((F.col("user_id") % 7).cast("int"), F.lit(0)).alias("pid"),
        F.lit(None).cast("string").alias("hostname"),
        F.col("value").alias("f_value"),
        F.col("user_id").alias("f_user_id"),
        F.regexp_extract("props", r"\{\"k\": (\d+)\}", 1).try_cast("long").alias("f_k"),
        (F.col("event_id") % 2 == 0).alias("f_even"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their fields nested."""
    e = events(spark, sf_dir)
    fields = [field("value", one(F.col("f_value")), DOUBLE, "units"), field("user_id", one(F.col("f_user_id")), INTEGER), field("k", one(F.col("f_k")), INTEGER), field("even", one(F.col("f_even")), BOOL)]
    return e.select("event_id", *HEADERS, F.array(*fields).cast(f"array<{FIELD_DDL}>").alias("fields"))


EVENTS_SQL = r"""m AS (SELECT event_id, unhex(md5(CAST(event_id AS VARCHAR))) AS uuid, epoch_us(ts) * 1000 AS ts_ns, event_type AS type,
  nullif('svc-' || (user_id % 5), 'svc-0') AS logger, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 6 ELSE 7 END AS severity,
  props AS payload, CAST(NULL AS VARCHAR) AS hostname, CAST(nullif(user_id % 7, 0) AS INTEGER) AS pid, value, user_id,
  TRY_CAST(regexp_extract(props, '\{"k": (\d+)\}', 1) AS BIGINT) AS k, event_id % 2 = 0 AS even FROM events)"""


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    headers = {"uuid": F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))), "timestamp": F.lit(0).cast("long"), "type": F.lit("document"), "logger": F.col("source"), "severity": F.lit(7), "payload": F.col("text"), "env_version": F.col("lang"), "pid": F.lit(None).cast("int"), "hostname": F.lit(None).cast("string")}
    return d.select("doc_id", *[c.alias(n) for n, c in headers.items()], F.array(field("n_chars", one(F.col("n_chars")), INTEGER)).cast(f"array<{FIELD_DDL}>").alias("fields"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    headers = {"uuid": F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))), "timestamp": F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000, "type": F.lit("order"), "logger": F.col("o_orderpriority"), "severity": F.lit(7), "payload": F.lit(None).cast("string"), "env_version": F.lit(None).cast("string"), "pid": F.lit(None).cast("int"), "hostname": F.lit(None).cast("string")}
    fields = [field("totalprice", one(F.col("o_totalprice")), DOUBLE), field("custkey", one(F.col("o_custkey")), INTEGER)]
    return o.select("o_orderkey", *[c.alias(n) for n, c in headers.items()], F.array(*fields).cast(f"array<{FIELD_DDL}>").alias("fields"))
