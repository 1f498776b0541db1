"""The message matcher: one boolean expression over message variables, as a Catalyst column.

``matcher(expr)`` is meant for ``filter``, where null counts as false: tests
that are false for nil are bare comparisons and tests that are true for nil are
``IS NULL OR ...``, both of which reach the Parquet scan. ``matched(expr)`` is
for projections and is never null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillet.functions import luapattern
from rillet.schema import BOOL, BYTES, DOUBLE, INT_MIN, INTEGER, STRING, VALUES

STRING_HEADERS = {"Type": "type", "Logger": "logger", "Hostname": "hostname", "EnvVersion": "env_version", "Payload": "payload"}
MOST_TESTS, MOST_STRING = 128, 255


class MatcherSyntaxError(ValueError):
    """invalid message matcher expression"""


@dataclass(frozen=True)
class Test:
    """value: str, float, or the marks NIL, True and False; mod: search literally."""

    variable: str
    op: str
    value: object = None
    mod: bool = False
    name: str = ""
    fi: int = 0
    ai: int = 0


@dataclass(frozen=True)
class Both:
    op: str  # && or ||
    left: object
    right: object


NIL = object()
_SPACE = re.compile(r"[ \r\n\t]*")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_TIME = re.compile(r"(\d{4})-(0[1-9]|1[0-2])-([12]\d|0[1-9]|3[01])T([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(\.\d+)?(?:(Z)|([-+])([01]\d|2[0-3])(:?)([0-5]\d))")
_QUOTED = {q: re.compile(rf"{q}((?:\\[{q}\\]|[^{q}])*+){q}", re.S) for q in "\"'"}
_INDEX = {False: re.compile(r"\[(25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)\]"), True: re.compile(r"\[(2[0-5][0-5]|1\d\d|[1-9]\d|\d)\]")}
_OPS = re.compile(r"==|!=|=~|!~|>=|>|<=|<")


class _Parser:
    def __init__(self, text: str, compat: bool):
        self.text, self.at, self.compat, self.tests = text, 0, compat, 1
        self.slots = [0, 0]
        self.postfix: list = []
        self.ops: list[str] = []

    def fail(self):
        raise MatcherSyntaxError(f"invalid message matcher expression at {self.at}: {self.text!r}")

    def space(self):
        self.at = _SPACE.match(self.text, self.at).end()

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def scan(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def whole(self):
        self.space()
        tree = self.ored()
        self.space()
        if self.at != len(self.text):
            self.fail()
        return tree

    def operator(self, op: str):
        self.tests += 1
        if self.tests > MOST_TESTS:
            self.fail()
        if self.ops and not (op == "&&" and self.ops[-1] in ("||", "(")) and self.ops[-1] != "(":
            self.postfix.append(self.ops.pop())
        self.ops.append(op)

    def ored(self):
        left = self.anded()
        while self.take("||"):
            self.operator("||")
            self.space()
            left = Both("||", left, self.anded())
        return left

    def anded(self):
        left = self.expr()
        while self.take("&&"):
            self.operator("&&")
            self.space()
            left = Both("&&", left, self.expr())
        return left

    def expr(self):
        if self.take("("):
            self.ops.append("(")
            self.space()
            inner = self.ored()
            if not self.take(")"):
                self.fail()
            while self.ops and self.ops[-1] != "(":
                self.postfix.append(self.ops.pop())
            self.space()
            return inner
        test = self.test()
        self.postfix.append(test)
        self.space()
        return test

    def op(self, *allowed: str) -> str:
        m = self.scan(_OPS)
        if not m or m[0] not in allowed:
            self.fail()
        self.space()
        return m[0]

    def string(self) -> str:
        quote = self.text[self.at : self.at + 1]
        m = self.scan(_QUOTED[quote]) if quote in _QUOTED else None
        if not m or len(m[1].encode()) > MOST_STRING or "\0" in m[1]:
            self.fail()
        return re.sub(rf"\\([{quote}\\])", r"\1", m[1])

    def number(self) -> float:
        m = self.scan(_NUMBER)
        if not m:
            self.fail()
        return float(m[0])

    def time(self) -> float:
        quote = self.text[self.at]
        self.at += 1
        m = self.scan(_TIME)
        if not m or not self.take(quote) or (self.compat and m[11]):
            self.fail()
        year, month, day, hour, minute, second = (int(m[k]) for k in range(1, 7))
        try:
            days = datetime(year, month, 1, tzinfo=timezone.utc).timestamp() + (day - 1) * 86400
        except (ValueError, OverflowError):
            self.fail()
        seconds = days + hour * 3600 + minute * 60 + second + float(m[7] or 0)
        if m[9]:
            offset = int(m[10]) * 3600 + int(m[12]) * 60
            seconds += offset if self.compat or m[9] == "-" else -offset
        self.slots = [hour, minute]
        return seconds * 1e9

    def index(self, slot: int) -> int:
        m = self.scan(_INDEX[self.compat])
        if m:
            self.slots[slot] = int(m[1])
        return int(m[1]) if m else self.slots[slot] if self.compat else 0

    def modifier(self) -> bool:
        return self.take("%")

    def test(self) -> Test:
        relational = ("==", "!=", ">=", ">", "<=", "<")
        if self.take("TRUE"):
            return Test("TRUE", "")
        if self.take("FALSE"):
            return Test("FALSE", "")
        for variable in ("Uuid", *STRING_HEADERS):
            if self.take(variable):
                self.space()
                op = self.op(*relational, "=~", "!~")
                if variable != "Uuid" and op in ("==", "!=") and self.take("NIL"):
                    return Test(variable, op, NIL)
                value = self.string()
                return Test(variable, op, value, op in ("=~", "!~") and self.modifier())
        if self.take("Timestamp"):
            self.space()
            op = self.op(*relational)
            return Test("Timestamp", op, self.time() if self.text[self.at : self.at + 1] in ("'", '"') else self.number())
        if self.take("Severity"):
            self.space()
            return Test("Severity", self.op(*relational), self.number())
        if self.take("Pid"):
            self.space()
            op = self.op(*relational)
            return Test("Pid", op, NIL if op in ("==", "!=") and self.take("NIL") else self.number())
        if self.take("Fields["):
            end = self.text.find("]", self.at)
            if end <= self.at or end - self.at > MOST_STRING:
                self.fail()
            name, self.at = self.text[self.at : end], end + 1
            fi, ai = self.index(0), self.index(1)
            self.space()
            op = self.op(*relational, "=~", "!~")
            mod = False
            if op in ("==", "!="):
                for token, value in (("NIL", NIL), ("TRUE", True), ("FALSE", False)):
                    if self.take(token):
                        return Test("Fields", op, value, False, name, fi, ai)
            if op in ("=~", "!~"):
                value = self.string()
                mod = self.modifier()
            else:
                value = self.string() if self.text[self.at : self.at + 1] in ("'", '"') else self.number()
            return Test("Fields", op, value, mod, name, fi, ai)
        self.fail()


def parse(text: str, compat: bool = False):
    """The expression's tree of ``Both`` and ``Test``.

    compat keeps known faults of an older parser: an operator after a closing
    parenthesis binds to what stands before it, a field without indices takes
    those last written, offsets of times are always added, and some indices
    over 205 are refused.
    """
    p = _Parser(text, compat)
    tree = p.whole()
    if not compat:
        return tree
    while p.ops:
        if (op := p.ops.pop()) != "(":
            p.postfix.append(op)
    stack: list = []
    for x in p.postfix:
        if isinstance(x, str):
            right, left = stack.pop(), stack.pop()
            stack.append(Both(x, left, right))
        else:
            stack.append(x)
    return stack.pop()


class Nested:
    """Columns of a message in its nested form; subclasses may name flat columns."""

    def header(self, name: str) -> Column:
        return F.col(name)

    def _field(self, name: str, fi: int) -> Column:
        return F.get(F.filter(F.col("fields"), lambda x: x["name"] == name), F.lit(fi))

    def _value(self, t: Test, kind: int, member: str) -> Column:
        f = self._field(t.name, t.fi)
        return F.when(f["value_type"] == kind, F.get(f[member], F.lit(t.ai)))

    def text(self, t: Test) -> tuple[Column, bool]:
        """The field as text, and whether that is bytes."""
        return F.coalesce(self._value(t, STRING, "value_string").cast("binary"), self._value(t, BYTES, "value_bytes")), True

    def number(self, t: Test) -> Column:
        return F.coalesce(self._value(t, INTEGER, "value_integer").cast("double"), self._value(t, DOUBLE, "value_double"))

    def truth(self, t: Test) -> Column:
        """Booleans as 1 and 0, and numbers."""
        return F.coalesce(self._value(t, BOOL, "value_bool").cast("double"), self.number(t))

    def exists(self, t: Test) -> Column:
        text, _ = self.text(t)
        return text.isNotNull() | self.truth(t).isNotNull()


class Flat(Nested):
    """Fields in columns of their own: name -> (column, kind); a field beyond the first value is missing."""

    def __init__(self, fields: dict[str, tuple[str, int]]):
        self.fields = fields

    def _one(self, t: Test, kinds: tuple[int, ...]) -> Column | None:
        column, own = self.fields.get(t.name, ("", None))
        return F.col(column) if own in kinds and not t.fi and not t.ai else None

    def text(self, t: Test) -> tuple[Column, bool]:
        found = self._one(t, (STRING, BYTES))
        return (F.lit(None).cast("string"), False) if found is None else (found, self.fields[t.name][1] == BYTES)

    def number(self, t: Test) -> Column:
        found = self._one(t, (INTEGER, DOUBLE))
        return F.lit(None).cast("double") if found is None else found

    def truth(self, t: Test) -> Column:
        found = self._one(t, (BOOL,))
        return found.cast("double") if found is not None else self.number(t)

    def exists(self, t: Test) -> Column:
        found = self._one(t, (STRING, BYTES, INTEGER, DOUBLE, BOOL))
        return F.lit(False) if found is None else found.isNotNull()

    def kind(self, t: Test) -> int | None:
        return self.fields.get(t.name, ("", None))[1]


COMPARE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
NIL_TRUE = {"!=", "<", "<=", "!~"}


def _text(column: Column, t: Test, binary: bool) -> Column:
    """The test where the text isn't nil; null where it is."""
    if t.op in ("=~", "!~"):
        found = luapattern.match(column, t.value, t.mod, binary)
        return found if t.op == "=~" else ~found
    return COMPARE[t.op](column, F.lit(bytearray(t.value.encode())) if binary else F.lit(t.value))


def _number(column: Column, op: str, value: float, whole: bool | None) -> Column:
    """Compares as doubles. whole: a column of 32-bit integers (True), of 64 bits (None), or of doubles (False)."""
    if whole and value == int(value) and abs(value) < 1 << 53:
        return COMPARE[op](column, F.lit(int(value)))
    exact = COMPARE[op](column.cast("double"), F.lit(value))
    if whole is None and op != "!=" and abs(value) < 9e18:
        # a wider range of integers, which storage can use, beside the exact test
        ulp = int(math.ulp(value)) + 1
        if op in (">", ">=", "=="):
            exact = (column >= F.lit(int(value) - ulp)) & exact
        if op in ("<", "<=", "=="):
            exact = (column <= F.lit(int(value) + ulp)) & exact
    if whole is False and op in (">", ">="):
        exact = ~F.isnan(column) & exact  # NaN is the largest double to Spark, and like no number here
    return exact


def compile(tree, columns: Nested | None = None) -> Column:  # noqa: A001
    columns = columns or Nested()
    if isinstance(tree, Both):
        left, right = compile(tree.left, columns), compile(tree.right, columns)
        return left & right if tree.op == "&&" else left | right
    t = tree
    if t.variable in ("TRUE", "FALSE"):
        return F.lit(t.variable == "TRUE")
    if t.variable in STRING_HEADERS:
        column = columns.header(STRING_HEADERS[t.variable])
        if t.value is NIL:
            return column.isNull() if t.op == "==" else column.isNotNull()
        found = _text(column, t, False)
        return column.isNull() | found if t.op in NIL_TRUE else found
    if t.variable == "Uuid":
        return _text(columns.header("uuid"), t, True)
    if t.variable == "Timestamp":
        return _number(columns.header("timestamp"), t.op, t.value, None)
    if t.variable == "Severity":
        return _number(columns.header("severity"), t.op, t.value, True)
    if t.variable == "Pid":
        column = columns.header("pid")
        if t.value is NIL:
            return column.isNull() if t.op == "==" else column.isNotNull()
        found = _number(column, t.op, t.value, True)
        return column.isNull() | found if COMPARE[t.op](INT_MIN, t.value) else found
    if t.value is NIL:
        return ~columns.exists(t) if t.op == "==" else columns.exists(t)
    if isinstance(t.value, bool):
        return COMPARE[t.op](columns.truth(t).cast("double"), F.lit(1.0 if t.value else 0.0))
    if isinstance(t.value, str):
        column, binary = columns.text(t)
        return _text(column, t, binary)
    return _number(columns.number(t), t.op, t.value, None if isinstance(columns, Flat) and columns.kind(t) == INTEGER else False)


def matcher(expression: str, columns: Nested | None = None, compat: bool = False) -> Column:
    """A condition for ``filter``."""
    return compile(parse(expression, compat), columns)


def matched(expression: str, columns: Nested | None = None, compat: bool = False) -> Column:
    """True or false for every row, for a projection."""
    return F.coalesce(matcher(expression, columns, compat), F.lit(False))


def _holds_text(value: bytes, t: Test) -> bool:
    if t.op in ("=~", "!~"):
        return luapattern.matches(value, t.value.encode(), t.mod) == (t.op == "=~")
    return COMPARE[t.op](value, t.value.encode())


def _holds_field(message: dict, t: Test) -> bool:
    named = [f for f in message.get("fields") or [] if f["name"] == t.name]
    found = named[t.fi] if t.fi < len(named) else {"value_type": None}
    kind = found["value_type"]
    values = (found.get(VALUES[kind]) or []) if kind in VALUES else []
    value = values[t.ai] if t.ai < len(values) else None
    if t.value is NIL:
        return (value is None) == (t.op == "==")
    if value is None:
        return False
    if isinstance(t.value, bool):
        return kind in (BOOL, INTEGER, DOUBLE) and COMPARE[t.op](float(value), float(t.value))
    if isinstance(t.value, str):
        return kind in (STRING, BYTES) and _holds_text(value.encode() if isinstance(value, str) else bytes(value), t)
    return kind in (INTEGER, DOUBLE) and COMPARE[t.op](float(value), t.value)


def holds(tree, message: dict) -> bool:
    """Whether one message, a dict of the schema's columns, passes; what ``compile`` says of its row."""
    if isinstance(tree, Both):
        either = holds(tree.left, message)
        return (either and holds(tree.right, message)) if tree.op == "&&" else either or holds(tree.right, message)
    t = tree
    if t.variable in ("TRUE", "FALSE"):
        return t.variable == "TRUE"
    if t.variable == "Fields":
        return _holds_field(message, t)
    if t.variable in STRING_HEADERS or t.variable == "Uuid":
        value = message.get(STRING_HEADERS.get(t.variable, "uuid"))
        if t.value is NIL:
            return (value is None) == (t.op == "==")
        if value is None:
            return t.op in NIL_TRUE and t.variable != "Uuid"
        return _holds_text(value.encode() if isinstance(value, str) else bytes(value), t)
    value = message.get(t.variable.lower())
    if t.value is NIL:
        return (value is None) == (t.op == "==")
    if value is None:
        return t.variable == "Pid" and COMPARE[t.op](INT_MIN, t.value)
    return COMPARE[t.op](float(value), t.value)


class MessageMatcher:
    """A matcher for plugins, which have one message at hand."""

    def __init__(self, expression: str, compat: bool = False):
        self.expression, self.tree = expression, parse(expression, compat)

    def eval(self, message: dict) -> bool:
        return holds(self.tree, message)
