"""The message model: fixed headers and an ordered list of typed, repeatable fields."""

from __future__ import annotations

import uuid as _uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRING, BYTES, INTEGER, DOUBLE, BOOL = range(5)
FIELD_DDL = (
    "struct<name:string,value_type:int,representation:string,value_string:array<string>,value_bytes:array<binary>,"
    "value_integer:array<bigint>,value_double:array<double>,value_bool:array<boolean>>"
)
#: timestamp is in nanoseconds since 1970; severity is 7 where a message has none.
MESSAGE_DDL = f"uuid binary, timestamp bigint, type string, logger string, severity int, payload string, env_version string, pid int, hostname string, fields array<{FIELD_DDL}>"
HEADERS = ["uuid", "timestamp", "type", "logger", "severity", "payload", "env_version", "pid", "hostname"]
VALUES = {STRING: "value_string", BYTES: "value_bytes", INTEGER: "value_integer", DOUBLE: "value_double", BOOL: "value_bool"}
KINDS = {STRING: "array<string>", BYTES: "array<binary>", INTEGER: "array<bigint>", DOUBLE: "array<double>", BOOL: "array<boolean>"}
INT_MIN = -(1 << 31)


def arrow_fields() -> list[pa.Field]:
    """The message's columns in Arrow, for workers, which have no session to parse DDL."""
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.float64(), pa.bool_()]
    member = pa.struct([("name", pa.string()), ("value_type", pa.int32()), ("representation", pa.string()), *[(c, pa.list_(t)) for c, t in zip(VALUES.values(), kinds)]])
    headers = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
    return [*[pa.field(h, t) for h, t in zip(HEADERS, headers)], pa.field("fields", pa.list_(member))]


def field(name: str, value: Column, kind: int, representation: str | None = None) -> Column:
    """A field with one value, or with the values of an array column."""
    members = [F.lit(name).alias("name"), F.lit(kind).alias("value_type"), F.lit(representation).cast("string").alias("representation")]
    for k, column in VALUES.items():
        members.append((value.cast(KINDS[k]) if k == kind else F.lit(None).cast(KINDS[k])).alias(column))
    return F.struct(*members)


def one(value: Column) -> Column:
    return F.array(value)


def make_message(df: DataFrame, fields: list[Column] = (), **headers: Column) -> DataFrame:
    """``df`` as messages; headers that aren't given are null, severity 7, timestamp 0, uuid random.

    Other columns are dropped. Fields that are null are left out.
    """
    defaults = {"uuid": F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))), "timestamp": F.lit(0), "severity": F.lit(7)}
    kinds = dict(part.split(" ", 1) for part in MESSAGE_DDL.split(", fields ")[0].split(", "))
    columns = [headers.get(h, defaults.get(h, F.lit(None))).cast(kinds[h]).alias(h) for h in HEADERS]
    listed = F.filter(F.array(*fields), lambda x: x.isNotNull()) if fields else F.array()
    return df.select(*columns, listed.cast(f"array<{FIELD_DDL}>").alias("fields"))


def promote_fields(df: DataFrame, names: dict[str, int], prefix: str = "f_") -> DataFrame:
    """``df`` with a flat column for each named field, so that storage prunes and filters by it."""
    return df.withColumns({f"{prefix}{n}": first_value(n, k) for n, k in names.items()})


def first_value(name: str, kind: int, fi: int = 0, ai: int = 0) -> Column:
    """The ai-th value of the fi-th field of that name, null if it's missing or of another type."""
    found = F.get(F.filter(F.col("fields"), lambda x: x["name"] == name), F.lit(fi))
    return F.when(found["value_type"] == kind, F.get(found[VALUES[kind]], F.lit(ai)))


class MessageError(ValueError):
    """A message that can't be encoded."""


def check_value(value, value_type: int | None = None) -> tuple[int, list]:
    """The type and list of a field's value, inferred where it isn't given."""
    listed = list(value) if isinstance(value, (list, tuple)) else [value]
    if not listed or listed[0] is None:
        raise MessageError("unsupported type: nil")
    kind = lambda v: "boolean" if isinstance(v, bool) else "numeric" if isinstance(v, (int, float)) else "string" if isinstance(v, (str, bytes)) else None
    first = kind(listed[0])
    if first is None:
        what = "unsupported array type" if isinstance(value, (list, tuple)) else "unsupported type"
        raise MessageError(f"{what}: {type(listed[0]).__name__}")
    if any(kind(v) != first for v in listed):
        raise MessageError("array has mixed types")
    allowed = {"string": (STRING, BYTES), "numeric": (DOUBLE, INTEGER), "boolean": (BOOL,)}[first]
    if value_type is None:
        value_type = BYTES if first == "string" and isinstance(listed[0], bytes) else allowed[0]
    if value_type not in allowed:
        raise MessageError(f"invalid {first} value_type: {value_type}")
    return value_type, listed


def message(fields=None, **headers) -> dict:
    """A message as a dict of the schema's columns, from plain Python values.

    ``fields`` is a list of dicts (name, value, value_type, representation), or
    a dict of name to value or to such a dict.
    """
    unknown = set(headers) - set(HEADERS)
    if unknown:
        raise MessageError(f"unknown header: {sorted(unknown)[0]}")
    out = {h: headers.get(h) for h in HEADERS}
    out["timestamp"], out["severity"] = headers.get("timestamp", 0), headers.get("severity", 7)
    out["uuid"] = uuid_bytes(headers.get("uuid"))
    if isinstance(fields, dict):
        fields = [{"name": n} | (v if isinstance(v, dict) else {"value": v}) for n, v in fields.items()]
    out["fields"] = []
    for f in fields or []:
        kind, values = check_value(f.get("value"), f.get("value_type"))
        convert = {STRING: lambda v: v if isinstance(v, str) else v.decode(), BYTES: lambda v: v if isinstance(v, bytes) else v.encode(), INTEGER: int, DOUBLE: float, BOOL: bool}[kind]
        row = {"name": f["name"], "value_type": kind, "representation": f.get("representation")} | dict.fromkeys(VALUES.values())
        row[VALUES[kind]] = [convert(v) for v in values]
        out["fields"].append(row)
    return out


def uuid_bytes(value) -> bytes:
    """16 raw bytes, or 36 characters of text; anything else gives a random one."""
    if isinstance(value, (bytes, bytearray)) and len(value) == 16:
        return bytes(value)
    if isinstance(value, str) and len(value) == 36:
        try:
            return _uuid.UUID(value).bytes
        except ValueError:
            pass
    return _uuid.uuid4().bytes
