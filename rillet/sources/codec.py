"""Binary messages and stream frames, in plain Python for use inside Arrow-batched functions.

A message is a protocol buffer with one-byte keys. A frame is 0x1e, the header's
length, the header (0x08 and the message's length), 0x1f, the message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from rillet.schema import BOOL, BYTES, DOUBLE, INTEGER, STRING, VALUES, MessageError, uuid_bytes

HEADER_SLACK = 3 + 255
MAX_MESSAGE = 64 << 10
_TEXT = {3: "type", 4: "logger", 6: "payload", 7: "env_version", 9: "hostname"}
_NUMBERS = {2: "timestamp", 5: "severity", 8: "pid"}


class _Bad(Exception):
    pass


class DecodeError(ValueError):
    pass


def varint(value: int) -> bytes:
    """Negative numbers take ten bytes, as two's complement of 64 bits."""
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for k in range(10):
        if at + k >= end:
            raise _Bad
        byte = data[at + k]
        value |= (byte & 127) << 7 * k
        if byte < 128:
            value &= (1 << 64) - 1
            return value - (1 << 64) if value >> 63 else value, at + k + 1
    raise _Bad


def _int32(value: int) -> int:
    value &= (1 << 32) - 1
    return value - (1 << 32) if value >> 31 else value


def _bytes(wire: int, data: bytes, at: int, end: int) -> tuple[bytes, int]:
    if wire != 2:
        raise _Bad
    size, at = read_varint(data, at, end)
    if size < 0 or size > end - at:
        raise _Bad
    return data[at : at + size], at + size


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _field(data: bytes, at: int, end: int) -> tuple[dict, int]:
    size, at = read_varint(data, at, end)
    if size <= 0 or size > end - at:
        raise _Bad
    end = at + size
    out = {"name": None, "value_type": STRING, "representation": None, **dict.fromkeys(VALUES.values())}
    while at < end:
        tag, wire = data[at] >> 3, data[at] & 7
        at += 1
        if tag in (1, 3):
            raw, at = _bytes(wire, data, at, end)
            out["name" if tag == 1 else "representation"] = _text(raw)
        elif tag == 2:
            if wire != 0:
                raise _Bad
            out["value_type"], at = read_varint(data, at, end)
        elif tag in (4, 5):
            raw, at = _bytes(wire, data, at, end)
            key = VALUES[STRING if tag == 4 else BYTES]
            out[key] = (out[key] or []) + [_text(raw) if tag == 4 else raw]
        elif tag in (6, 8):
            key, values = VALUES[INTEGER if tag == 6 else BOOL], []
            if wire == 0:
                v, at = read_varint(data, at, end)
                values.append(v)
            else:
                raw, at = _bytes(wire, data, at, end)
                k = 0
                while k < len(raw):
                    v, k = read_varint(raw, k, len(raw))
                    values.append(v)
            out[key] = (out[key] or []) + (values if tag == 6 else [v != 0 for v in values])
        elif tag == 7:
            if wire == 1:
                raw, at = data[at : at + 8], at + 8
                if at > end:
                    raise _Bad
            else:
                raw, at = _bytes(wire, data, at, end)
                if len(raw) % 8:
                    raise _Bad
            out["value_double"] = (out["value_double"] or []) + list(struct.unpack(f"<{len(raw) // 8}d", raw))
        else:
            raise _Bad
    if out["name"] is None:
        raise _Bad
    return out, at


def _decode(data: bytes) -> tuple[dict, set[int]]:
    """The message and the tags seen; _Bad with (tag, wire type, place of the last good end)."""
    out = {"uuid": None, "timestamp": 0, "type": None, "logger": None, "severity": 7, "payload": None, "env_version": None, "pid": None, "hostname": None, "fields": []}
    at = last = tag = wire = 0
    seen = set()
    try:
        while at < len(data):
            tag, wire = data[at] >> 3, data[at] & 7
            at += 1
            if tag == 1:
                out["uuid"], at = _bytes(wire, data, at, len(data))
                if len(out["uuid"]) != 16:
                    raise _Bad
            elif tag in _TEXT:
                raw, at = _bytes(wire, data, at, len(data))
                out[_TEXT[tag]] = _text(raw)
            elif tag in _NUMBERS:
                if wire != 0:
                    raise _Bad
                v, at = read_varint(data, at, len(data))
                out[_NUMBERS[tag]] = v if tag == 2 else _int32(v)
            elif tag == 10 and wire == 2:
                f, at = _field(data, at, len(data))
                out["fields"].append(f)
            else:
                raise _Bad
            seen.add(tag)
            last = at
    except _Bad:
        raise _Bad(tag, wire, last) from None
    return out, seen


def decode(data: bytes) -> dict:
    """A message by the schema's columns, or DecodeError; all or nothing."""
    if not data:
        raise DecodeError("no data")
    try:
        out, seen = _decode(data)
    except _Bad as e:
        tag, wire, at = e.args
        raise DecodeError(f"tag:{tag} wiretype:{wire} position:{at}") from None
    for tag, name in ((1, "Uuid"), (2, "Timestamp")):
        if tag not in seen:
            raise DecodeError(f"missing {name}")
    return out


def decode_strict(data: bytes) -> dict:
    """As ``decode``, with the errors of the scripting interface."""
    if data is None or len(data) < 20:
        raise DecodeError("invalid message, too short")
    try:
        out, seen = _decode(data)
    except _Bad as e:
        tag, wire, at = e.args
        raise DecodeError(f"error in tag: {tag} wiretype: {wire} offset: {at}") from None
    if not {1, 2} <= seen:
        found = ["found" if t in seen else "not found" for t in (1, 2)]
        raise DecodeError(f"missing required field uuid: {found[0]} timestamp: {found[1]}")
    return out


def _part(tag: int, raw: bytes) -> bytes:
    return bytes([tag << 3 | 2]) + varint(len(raw)) + raw


def _raw(value) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def encode_field(f: dict) -> bytes:
    """Numbers and booleans of more than one value are packed; strings repeat."""
    kind = f.get("value_type") or STRING
    values = f.get(VALUES[kind])
    if not values:
        raise MessageError("unsupported type: nil")
    out = _part(1, _raw(f["name"]))
    if kind != STRING:
        out += b"\x10" + varint(kind)
    if f.get("representation") is not None:
        out += _part(3, _raw(f["representation"]))
    if kind in (STRING, BYTES):
        return out + b"".join(_part(4 + kind, _raw(v)) for v in values)
    body = struct.pack(f"<{len(values)}d", *values) if kind == DOUBLE else b"".join(varint(int(v)) for v in values)
    tag = {INTEGER: 6, DOUBLE: 7, BOOL: 8}[kind]
    if len(values) > 1:
        return out + _part(tag, body)
    return out + bytes([tag << 3 | (1 if kind == DOUBLE else 0)]) + body


def encode(message: dict, framed: bool = False) -> bytes:
    out = _part(1, uuid_bytes(message.get("uuid"))) + b"\x10" + varint(int(message.get("timestamp") or 0))
    for tag, name in ((3, "type"), (4, "logger"), (5, "severity"), (6, "payload"), (7, "env_version"), (8, "pid"), (9, "hostname")):
        value = message.get(name)
        if value is None:
            continue
        out += bytes([tag << 3]) + varint(int(value)) if tag in _NUMBERS else _part(tag, _raw(value))
    for f in message.get("fields") or []:
        out += _part(10, encode_field(f))
    return frame_header(len(out)) + out if framed else out


def frame_header(size: int) -> bytes:
    head = b"\x08" + varint(size)
    return b"\x1e" + bytes([len(head)]) + head + b"\x1f"


def _header_size(head: bytes, most: int) -> int:
    """The message length a frame header tells, 0 if it isn't one."""
    if head[:1] != b"\x08" or len(head) < 2:
        return 0
    try:
        size, _ = read_varint(head, 1, len(head))
    except _Bad:
        return 0
    return size if 0 < size <= most else 0


class StreamReader:
    """Finds messages in a stream that arrives in pieces, and skips what is none.

    ``find`` returns the next message or None, and how many bytes it discarded.
    With ``decode=False`` any framed bytes pass, as ``raw`` alone.
    """

    def __init__(self, max_message: int = MAX_MESSAGE, decode: bool = True):
        self.buffer, self.at, self.most, self.decode = bytearray(), 0, max_message, decode
        self.consumed = 0

    def feed(self, data: bytes) -> None:
        del self.buffer[: self.at]
        self.at = 0
        self.buffer += data

    def _skip(self, n: int) -> int:
        self.at += n
        self.consumed += n
        return n

    def skip(self) -> bool:
        """At the end of all data: passes over a frame that breaks off; false if there is nothing left."""
        return bool(self.at < len(self.buffer) and self._skip(1))

    def find(self) -> tuple[dict | None, int]:
        discarded = 0
        while self.at < len(self.buffer):
            start = self.buffer.find(0x1E, self.at)
            if start < 0:
                return None, discarded + self._skip(len(self.buffer) - self.at)
            discarded += self._skip(start - self.at)
            if len(self.buffer) - self.at < 2:
                break
            body = self.at + self.buffer[self.at + 1] + 3
            if body > len(self.buffer):
                break
            if self.buffer[body - 1] == 0x1F and (size := _header_size(bytes(self.buffer[self.at + 2 : body - 1]), self.most)):
                if body + size > len(self.buffer):
                    break
                raw = bytes(self.buffer[body : body + size])
                try:
                    found = (decode(raw) if self.decode else {}) | {"raw": raw}
                    self._skip(body + size - self.at)
                    return found, discarded
                except DecodeError:
                    pass
            discarded += self._skip(1)
        return None, discarded


def frames(data: bytes, start: int = 0, stop: int | None = None, max_message: int = MAX_MESSAGE, decoded: bool = True) -> Iterator[tuple[int, int, bytes, dict]]:
    """offset, bytes discarded before, raw bytes and message of each frame that begins in [start, stop)."""
    stop = len(data) if stop is None else stop
    at = last = start
    while (at := data.find(b"\x1e", at)) >= 0 and at < stop:
        body = at + data[at + 1] + 3 if at + 1 < len(data) else len(data) + 1
        if body <= len(data) and data[body - 1] == 0x1F and (size := _header_size(data[at + 2 : body - 1], max_message)) and body + size <= len(data):
            raw = data[body : body + size]
            try:
                found = decode(raw) if decoded else {}
                yield at, at - last, raw, found
                at = last = body + size
                continue
            except DecodeError:
                pass
        at += 1
