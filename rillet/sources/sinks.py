"""Sinks for messages: payload files, batched database rows, Kafka, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.operators.accessors import payload_filename, read_message
from rillet.schema import STRING

TRUNCATED = "TRUNCATED:"


def payload_files(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Payloads as text in a folder for each logger, payload name and payload type."""
    name, kind = (F.coalesce(read_message(f"Fields[{f}]", kind=STRING), F.lit(d)) for f, d in (("payload_name", ""), ("payload_type", "txt")))
    rows = messages.where("payload is not null").select(payload_filename(F.col("logger"), name, kind).alias("name"), F.col("payload").alias("value"))
    rows.write.mode(mode).partitionBy("name").text(path)


def truncated(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters; what is cut begins with a mark."""
    return F.when(F.length(text) > most, F.concat(F.lit(TRUNCATED), F.substring(text, 1, max(most - len(TRUNCATED), 0)))).otherwise(text)


def database_columns(messages: DataFrame, columns: dict[str, tuple[str, str, int | None]]) -> DataFrame:
    """A projection for a table: name -> (message variable, SQL type, longest text); times become seconds."""
    out = []
    for name, (variable, kind, most) in columns.items():
        value = read_message(variable)
        if variable == "Timestamp":
            value = F.timestamp_micros(F.expr("timestamp div 1000")) if kind == "timestamp" else value / 1e9
        if most is not None:
            value = truncated(value.cast("string"), most)
        out.append(value.cast(kind).alias(name))
    return messages.select(*out)


def to_database(rows: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Appends through JDBC, ``batch`` rows at a time; the driver must be on the class path."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def to_kafka(frames: DataFrame, servers: str, topic: str) -> None:
    """Frames (raw) to a topic, at least once; the connector must be on the class path."""
    frames.select(F.col("raw").alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
