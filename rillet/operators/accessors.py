"""Reading message variables as columns, header defaults, and payload helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.schema import DOUBLE, FIELD_DDL, HEADERS, INTEGER, STRING, VALUES, field, one
from rillet.sources.framed import frame_header, framed_size

_NAMES = {"Uuid": "uuid", "Timestamp": "timestamp", "Type": "type", "Logger": "logger", "Severity": "severity", "Payload": "payload", "EnvVersion": "env_version", "Pid": "pid", "Hostname": "hostname", "raw": "raw"}


def read_message(variable: str, fi: int = 0, ai: int = 0, kind: int | None = None) -> Column:
    """A variable's column: a header, raw, framed, size, or the ai-th value of the fi-th ``Fields[name]``.

    Indices begin at 0; a value that isn't there is null. A field's value comes
    as text unless ``kind`` names its type. Unknown variables and negative
    indices are errors.
    """
    if fi < 0 or ai < 0:
        raise ValueError("field and array index must be >= 0")
    if variable in _NAMES:
        return F.col(_NAMES[variable])
    if variable == "size":
        return F.octet_length("raw").cast("long")
    if variable == "framed":
        return F.concat(frame_header(F.octet_length("raw")), F.col("raw"))
    if variable == "framed_size":
        return framed_size(F.col("raw")).cast("long")
    m = re.fullmatch(r"Fields\[([^\]]+)\]", variable)
    if not m:
        raise ValueError(f"read_message() field: '{variable}' not supported/recognized")
    found = F.get(F.filter(F.col("fields"), lambda x: x["name"] == m[1]), F.lit(fi))
    value = lambda k: F.when(found["value_type"] == k, F.get(found[VALUES[k]], F.lit(ai)))
    if kind is not None:
        return value(kind)
    return F.coalesce(value(STRING), F.decode(value(1), "UTF-8"), value(INTEGER).cast("string"), value(DOUBLE).cast("string"), value(4).cast("string"))


def read_number(variable: str, fi: int = 0, ai: int = 0) -> Column:
    """A numeric field as a double, whichever number type it has."""
    return F.coalesce(read_message(variable, fi, ai, INTEGER).cast("double"), read_message(variable, fi, ai, DOUBLE))


def header_defaults(df: DataFrame, config: dict, now: Column | None = None) -> DataFrame:
    """Logger, hostname and pid from ``config`` where a message has none; where it has no timestamp or uuid, now and a random one."""
    own = {h: F.coalesce(F.col(h), F.lit(config[h]).cast(df.schema[h].dataType)) for h in ("logger", "hostname", "pid") if h in config}
    now = F.unix_micros(F.current_timestamp()) * 1000 if now is None else now
    always = {"timestamp": F.coalesce("timestamp", now), "uuid": F.coalesce("uuid", F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))))}
    return df.withColumns(own | {h: c for h, c in always.items() if h in df.columns})


def restricted_headers(df: DataFrame, config: dict, now: Column | None = None) -> DataFrame:
    """Overwrites uuid, timestamp, logger, hostname and pid, whatever a message says."""
    now = F.unix_micros(F.current_timestamp()) * 1000 if now is None else now
    own = {h: F.lit(config.get(h)).cast(df.schema[h].dataType) for h in ("logger", "hostname", "pid")}
    return df.withColumns({"uuid": F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))), "timestamp": now, **own})


def explode_fields(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each field, in order: the kept columns, position, and the field's members."""
    return df.select(*keep, F.posexplode("fields").alias("position", "field")).select(*keep, "position", "field.*")


def inject_payload(payload: Column, payload_type: str = "txt", payload_name: str | None = None, **headers: Column) -> list[Column]:
    """Columns of a message that carries text; rows with an empty payload are for the caller to drop.

    The name is a field only if it is given.
    """
    fields = [field("payload_type", one(F.lit(payload_type)), STRING)]
    if payload_name is not None:
        fields.append(field("payload_name", one(F.lit(payload_name)), STRING))
    given = {"type": F.lit("inject_payload"), "payload": payload, "severity": F.lit(7), **headers}
    nulls = {"uuid": "binary", "timestamp": "bigint", "logger": "string", "env_version": "string", "pid": "int", "hostname": "string"}
    return [given.get(h, F.lit(None).cast(nulls.get(h, "string"))).alias(h) for h in HEADERS] + [F.array(*fields).cast(f"array<{FIELD_DDL}>").alias("fields")]


def payload_filename(*parts: Column) -> Column:
    """A file name of logger, payload name and type: everything but letters and digits is an underscore."""
    return F.concat_ws(".", *[F.regexp_replace(F.coalesce(p, F.lit("")), "[^A-Za-z0-9]", "_") for p in parts])


def output(*values: Column, limit: int | None = None) -> Column:
    """Values next to one another as text: nil for null, true, false, numbers by ``number_text``."""
    from rillet.functions.scalar import number_text

    if not values:
        raise ValueError("output() must have at least one argument")
    text = F.concat(*[F.coalesce(v.cast("string"), F.lit("nil")) if kind != "number" else F.coalesce(number_text(v), F.lit("nil")) for v, kind in [x if isinstance(x, tuple) else (x, "") for x in values]])
    return text if limit is None else F.when(F.octet_length(text) > limit, F.raise_error(F.lit("output_limit exceeded"))).otherwise(text)
