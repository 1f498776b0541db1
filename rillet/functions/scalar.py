"""Scalar functions for plugins and queries: strings as bytes, doubles, UTC times, arrays.

Everything is a Catalyst expression but what Spark has no equal of: exact
number text, C's %g, erf, frexp, and patterns with positions, balances or
limits, which are Arrow-batched functions. Null gives null.
"""

from __future__ import annotations

import math
import re
import string as _string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rillet.functions import capture, luapattern

_ALPHA = (_string.ascii_uppercase, _string.ascii_lowercase)


# strings: lengths and places count bytes, from 1, or from the end if negative
def length(s: Column) -> Column:
    return F.octet_length(s)


def sub(s: Column, i: int, j: int = -1) -> Column:
    """Bytes i to j, as text; bounds are clamped, and an empty range gives an empty string."""
    n = F.octet_length(s)
    a = F.lit(i) if i > 0 else F.greatest(n + i + 1, F.lit(1)) if i < 0 else F.lit(1)
    b = F.least(F.lit(j), n) if j >= 0 else n + j + 1
    return F.substring(s.cast("binary"), a, F.greatest(b - a + 1, F.lit(0))).cast("string")


def upper(s: Column) -> Column:
    return F.translate(s, _ALPHA[1], _ALPHA[0])


def lower(s: Column) -> Column:
    return F.translate(s, *_ALPHA)


def rep(s: Column, n: int) -> Column:
    return F.repeat(s, max(n, 0))


def reverse(s: Column) -> Column:
    """The bytes in reverse order, whatever characters they were part of."""
    return F.unhex(F.regexp_replace(F.reverse(F.hex(s.cast("binary"))), "(.)(.)", "$2$1")).cast("string")


def byte(s: Column, i: int = 1) -> Column:
    """The i-th byte as a number, null beyond the ends."""
    two = F.hex(F.substring(s.cast("binary"), i, 1))
    return F.when((two != "") & F.lit(i != 0), F.conv(two, 16, 10).cast("int"))


def byte_range(s: Column, i: int = 1, j: int | None = None) -> Column:
    """Bytes i to j as an array of numbers; bounds are clamped as in ``sub``."""
    pairs = F.regexp_extract_all(F.hex(sub(s, i, i if j is None else j).cast("binary")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda two: F.conv(two, 16, 10).cast("int"))


def char(*codes: Column) -> Column:
    """Bytes by number; numbers beyond 0-255 are errors."""
    one = lambda c: F.when((c < 0) | (c > 255), F.raise_error(F.lit("invalid value"))).otherwise(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return F.unhex(F.concat(*map(one, codes)))


def find_plain(s: Column, needle: str, init: int = 1) -> Column:
    """The byte place of the first occurrence from ``init``, null if there is none."""
    raw = F.decode(s.cast("binary"), "ISO-8859-1")
    at = F.locate(needle.encode().decode("latin-1"), raw, init)
    return F.when(at > 0, at)


def _java(pattern: str, keep_anchor: bool = True) -> str:
    """A pattern with captures as a Java regular expression for text."""
    out, k, n = [], 0, len(pattern)
    while k < n:
        c = pattern[k]
        if c == "^" and k == 0 and keep_anchor:
            out.append("\\A")
            k += 1
            continue
        if c == "$" and k == n - 1:
            out.append("\\z")
            k += 1
            continue
        if c in "()":
            if pattern[k : k + 2] == "()":
                raise ValueError("position captures have no column form")
            out.append(c)
            k += 1
            continue
        if c == "%" and k + 1 < n and pattern[k + 1].isdigit():
            out.append("\\" + pattern[k + 1])
            k += 2
            continue
        if c == "%" and pattern[k + 1 : k + 2] in ("b", "f"):
            if pattern[k + 1] == "b":
                raise ValueError("balanced matches have no column form")
            chars, end = luapattern.set_at(pattern.encode(), k + 2)
            body = luapattern.java_set(chars)
            out.append(f"(?<!{body})(?={body}{'|' + chr(92) + 'z' if 0 in chars else ''})")
            k = end
            continue
        if c == "[":
            chars, end = luapattern.set_at(pattern.encode(), k)
            body = luapattern.java_set(chars) if max(chars, default=0) < 128 else luapattern.java_set(chars)[:-1] + "\\x{100}-\\x{10ffff}]"
            k = end
        elif c == "%" and k + 1 < n:
            chars = luapattern.class_of(ord(pattern[k + 1]))
            body = luapattern.java_set(chars) if max(chars) < 128 else luapattern.java_set(chars)[:-1] + "\\x{100}-\\x{10ffff}]"
            k += 2
        else:
            body = "(?s:.)" if c == "." else re.escape(c)
            k += 1
        if k < n and pattern[k] in "*+?-":
            body += "*?" if pattern[k] == "-" else pattern[k]
            k += 1
        out.append(body)
    return "".join(out)


def _text(value) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _batched(kind: str, function):
    """An Arrow-batched function of the bytes of a text; null for null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v.encode()) for v in values], dtype=object)

    return run


def _special(pattern: str) -> bool:
    """Whether a pattern has position captures or balances, which no column form has."""
    bare = re.sub("%[^b]", "", re.sub(r"\[\^?\]?(?:%.|[^\]])*\]", "", pattern, flags=re.S), flags=re.S)
    return "()" in bare or "%b" in bare


def find(s: Column, pattern: str, init: int = 1, plain: bool = False) -> Column:
    """first and last (bytes, from 1), and captures as text, positions as numbers; null for no match."""
    raw = pattern.encode()
    plain or capture.compiled(raw)  # a bad pattern fails at once

    @F.pandas_udf("struct<first:int,last:int,captures:array<string>>")
    def run(values: pd.Series) -> pd.DataFrame:
        found = [None if v is None else capture.find(v.encode(), raw, init, plain) for v in values]
        rows = [(None, None, None) if f is None else (f[0], f[1], list(map(_text, f[2]))) for f in found]
        return pd.DataFrame(rows, columns=["first", "last", "captures"]).astype({"first": "Int32", "last": "Int32"})

    got = run(s)
    return F.when(got["first"].isNotNull(), got)


def match(s: Column, pattern: str, group: int | None = None, init: int = 1) -> Column:
    """A capture, or the whole match where there are none; null for no match.

    Patterns with positions or balances, and places to begin at, take a batched
    function; other patterns are regular expressions over characters.
    """
    if init != 1 or _special(pattern):
        raw = pattern.encode()
        capture.compiled(raw)

        def one(v):
            got = capture.match(v, raw, init)
            return None if got is None else _text(got[(group or 1) - 1])

        return _batched("string", one)(s)
    regex = _java(pattern)
    group = (1 if re.search(r"(?<!\\)\((?!\?)", regex) else 0) if group is None else group
    return F.when(s.rlike(regex), F.regexp_extract(s, regex, group))


def gmatch(s: Column, pattern: str, group: int | None = None) -> Column:
    """All matches; ^ has no meaning of its own here."""
    if _special(pattern):
        raw = pattern.encode()
        return _batched("array<string>", lambda v: [_text(m[(group or 1) - 1]) for m in capture.gmatch(v, raw)])(s)
    regex = _java(pattern, keep_anchor=False)
    group = (1 if re.search(r"(?<!\\)\((?!\?)", regex) else 0) if group is None else group
    return F.regexp_extract_all(s, F.lit(regex), F.lit(group))


def gmatch_all(s: Column, pattern: str) -> Column:
    """All captures of all matches, an array for each match."""
    raw = pattern.encode()
    capture.compiled(raw)
    return _batched("array<array<string>>", lambda v: [list(map(_text, m)) for m in capture.gmatch(v, raw)])(s)


def gsub(s: Column, pattern: str, replacement, most: int | None = None) -> Column:
    """At most ``most`` matches replaced, all by default; %0 to %9 stand for captures.

    The replacement may also be a dict, looked up by the first capture, or a
    function of the captures (bytes, and numbers for positions); what they have
    no answer for stays.
    """
    if not isinstance(replacement, str) or most is not None or _special(pattern):
        raw = pattern.encode()
        capture.compiled(raw)
        new = {k.encode() if isinstance(k, str) else k: v for k, v in replacement.items()} if isinstance(replacement, dict) else replacement.encode() if isinstance(replacement, str) else replacement
        return _batched("string", lambda v: _text(capture.gsub(v, raw, new, most)[0]))(s)
    java = re.sub(r"%(\d)|%(.)|([\\$])", lambda m: f"${m[1]}" if m[1] else m[2] if m[2] else "\\" + m[3], replacement)
    return F.regexp_replace(s, F.lit(_java(pattern)), F.lit(java))


def gsub_count(s: Column, pattern: str) -> Column:
    if _special(pattern):
        raw = pattern.encode()
        return _batched("int", lambda v: capture.gsub(v, raw, b"")[1])(s)
    return F.regexp_count(s, F.lit(_java(pattern)))


def gsub_table(s: Column, pattern: str, table: dict[str, str], most: int | None = None) -> Column:
    """Matches replaced by their entry in ``table``; those without one stay."""
    return gsub(s, pattern, table, most)


def format(fmt: str, *args: Column) -> Column:  # noqa: A001
    """C's string formatting; %q quotes. Widths and precisions have two digits at most."""
    specs = re.findall(r"%[-+ #0]*\d{0,2}(?:\.\d{0,2})?([cdiouxXeEfgGqs%])", fmt)
    if fmt.replace("%%", "").count("%") != sum(s != "%" for s in specs):
        raise ValueError("invalid option to 'format'")
    kinds = [s for s in specs if s != "%"]

    plain = re.sub(r"%q", "%s", re.sub(r"(%[-+ #0]*\d*(?:\.\d*)?)c", r"\1s", fmt))

    def value(text: str, kind: str):
        """From a number's text, for pandas has no whole numbers beside nulls."""
        if kind in "cdiouxX":
            v = int(text) if re.fullmatch(r"-?\d+", text) else int(float(text))
            return chr(v) if kind == "c" else v & (1 << 64) - 1 if kind in "ouxX" else v
        if kind == "q":
            return '"' + re.sub(r'["\\\n]', lambda m: "\\" + m[0], text).replace("\r", "\\r").replace("\0", "\\000") + '"'
        return float(text) if kind in "eEfgG" else text

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else plain % tuple(map(value, row, kinds)) for row in zip(*columns)], dtype=object)

    return run(*[a.cast("string") for a in args]) if args else F.lit(fmt.replace("%%", "%"))


# mathematics: doubles in, doubles out, with C's answers at the edges
_PLAIN = "abs acos asin atan cos cosh exp sin sinh sqrt tan tanh degrees radians".split()


def math_function(name: str, x: Column) -> Column:
    x = x.cast("double")
    if name in _PLAIN:
        return getattr(F, name)(x).cast("double")
    if name in ("deg", "rad"):
        return (F.degrees if name == "deg" else F.radians)(x)
    if name in ("ceil", "floor"):
        # beyond 2**53 every double is whole, and a long has no room for the largest
        return F.when(F.abs(x) < 2.0**53, getattr(F, name)(x).cast("double")).otherwise(x)
    if name in ("log", "log10"):
        fn = F.ln if name == "log" else F.log10
        return F.when(x > 0, fn(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    raise ValueError(f"no function {name}")


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def pow(x: Column, y: Column) -> Column:  # noqa: A001
    return F.pow(x, y)


def fmod(x: Column, y: Column) -> Column:
    """Truncated remainder; NaN for a divisor of 0."""
    return F.when(y != 0, x % F.when(y != 0, y)).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(float("nan"))))


def mod(a: Column, b: Column) -> Column:
    """The floored remainder of the % operator."""
    safe = F.when(b != 0, b)
    return F.coalesce(a - F.floor(a / safe) * safe, F.when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))))


def divide(a: Column, b: Column) -> Column:
    """C's division: infinities and NaN instead of errors."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(a.isNotNull() & b.isNotNull(), by_zero)


def modf(x: Column) -> Column:
    """A struct of the whole and the fractional part; the fraction of an infinity is 0. Null for null."""
    x = x.cast("double")
    whole = F.when(x >= 0, math_function("floor", x)).otherwise(math_function("ceil", x))
    return F.when(x.isNotNull(), F.struct(whole.alias("whole"), F.when(F.abs(x) == float("inf"), F.lit(0.0)).otherwise(x - whole).alias("fraction")))


def huge() -> Column:
    return F.lit(float("inf"))


def pi() -> Column:
    return F.lit(math.pi)


def ldexp(x: Column, e: Column) -> Column:
    return x * F.pow(F.lit(2.0), e)


def _vectorised(function, kind: str):
    """A function of doubles, NaN among them; null gives null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return lambda x: F.when(x.isNotNull(), run(x))


def erf(x: Column) -> Column:
    return _vectorised(math.erf, "double")(x)


def erfc(x: Column) -> Column:
    return _vectorised(math.erfc, "double")(x)


def frexp(x: Column) -> Column:
    @F.pandas_udf("struct<mantissa:double,exponent:int>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([math.frexp(v) for v in values], columns=["mantissa", "exponent"])

    return F.when(x.isNotNull(), run(x.cast("double")))


def random(low: int | None = None, high: int | None = None, seed: int | None = None) -> Column:
    """[0, 1), or whole numbers from 1 to ``low``, or from ``low`` to ``high``."""
    r = F.rand(seed)
    if low is None:
        return r
    low, high = (1, low) if high is None else (low, high)
    if low > high:
        raise ValueError("interval is empty")
    return F.floor(r * (high - low + 1)) + low


def next_power_of_two(x: Column) -> Column:
    """The least power of two that isn't smaller; 0 for 0."""
    bits = F.when(x == 1, F.lit(0)).otherwise(F.length(F.bin(x.cast("long") - 1)))
    return F.when(x <= 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


# dates, always UTC
_STRFTIME = {
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "d": "dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "S": "ss", "y": "yy", "Y": "yyyy",
    "D": "MM/dd/yy", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "h": "MMM", "x": "MM/dd/yy", "X": "HH:mm:ss", "r": "hh:mm:ss a",
}


def _specifier(spec: str, t: Column, seconds: Column) -> Column:
    """What a formatter's pattern can't express."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    day, sunday = F.dayofyear(t) - 1, F.dayofweek(t) - 1
    monday = F.pmod(sunday + 6, F.lit(7))
    year = F.expr("1") * F.year(t)
    iso = F.year(F.date_add(t.cast("date"), 3 - monday))  # the year of the week's Thursday
    known = {
        "e": lambda: F.lpad(F.dayofmonth(t).cast("string"), 2, " "), "C": lambda: two(F.floor(year / 100)), "u": lambda: (monday + 1).cast("string"), "w": lambda: sunday.cast("string"),
        "U": lambda: two(F.floor((day + 7 - sunday) / 7)), "W": lambda: two(F.floor((day + 7 - monday) / 7)), "V": lambda: two(F.weekofyear(t)), "G": lambda: iso.cast("string"), "g": lambda: two(iso % 100),
        "z": lambda: F.lit("+0000"), "Z": lambda: F.lit("UTC"), "s": lambda: F.floor(seconds).cast("long").cast("string"), "n": lambda: F.lit("\n"), "t": lambda: F.lit("\t"), "%": lambda: F.lit("%"),
        "c": lambda: F.concat(F.date_format(t, "EEE MMM "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.date_format(t, " HH:mm:ss yyyy")),
    }
    if spec not in known:
        raise ValueError(f"invalid conversion specifier '%{spec}'")
    return known[spec]()


def date(fmt: str, seconds: Column) -> Column:
    """strftime of a time in seconds."""
    fmt = fmt.removeprefix("!")
    t, out = F.timestamp_seconds(seconds), []
    if re.sub(r"%.", "", fmt, flags=re.S).endswith("%"):
        raise ValueError("invalid conversion specifier '%'")
    for literal, spec in re.findall(r"([^%]+)|%(.)", fmt, flags=re.S):
        out.append(F.lit(literal) if literal else F.date_format(t, _STRFTIME[spec]) if spec in _STRFTIME else _specifier(spec, t, seconds))
    return F.when(seconds.isNotNull(), F.concat(*out)) if out else F.when(seconds.isNotNull(), F.lit(""))


def difftime(later: Column, earlier: Column) -> Column:
    """Seconds between two times, as a double."""
    return (later - earlier).cast("double")


def date_table(seconds: Column) -> Column:
    """The parts of a time: year, month, day, hour, min, sec, wday (from Sunday, 1), yday, and isdst, which UTC never is."""
    t = F.timestamp_seconds(seconds)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "min": F.minute, "sec": F.second, "wday": F.dayofweek, "yday": F.dayofyear}
    return F.struct(*[fn(t).cast("int").alias(n) for n, fn in parts.items()], F.lit(False).alias("isdst"))


def time(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, sec: Column | None = None) -> Column:
    """Seconds of a UTC time; at noon where no hour is given. Parts may exceed their range."""
    first = F.make_date(year + F.floor((month - 1) / 12).cast("int"), F.pmod(month - 1, F.lit(12)) + 1, F.lit(1))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
    hour, minute, sec = F.lit(12) if hour is None else hour, F.lit(0) if minute is None else minute, F.lit(0) if sec is None else sec
    return days.cast("long") * 86400 + hour * 3600 + minute * 60 + sec


# arrays
def concat(t: Column, sep: str = "", i: int = 1, j: int | None = None) -> Column:
    n = F.size(t) if j is None else F.least(F.lit(j), F.size(t))
    return F.array_join(F.slice(t, i, F.greatest(n - i + 1, F.lit(0))), sep)


def insert(t: Column, value: Column, at: int | None = None) -> Column:
    return F.array_append(t, value) if at is None else F.array_insert(t, at, value)


def remove(t: Column, at: int | None = None) -> Column:
    """The array without its element ``at``, the last by default; beyond its ends, unchanged."""
    place = F.size(t) if at is None else F.lit(at)
    return F.filter(t, lambda x, k: k + 1 != place)


def sort(t: Column, descending: bool = False, less=None) -> Column:
    """An array in order; ``less`` is a function of two elements' columns that tells whether the first comes first."""
    if less is not None:
        return F.array_sort(t, lambda x, y: F.when(less(x, y), -1).when(less(y, x), 1).otherwise(0))
    return F.sort_array(t, not descending)


def maxn(m: Column) -> Column:
    """The largest positive numeric key of a map, else 0."""
    return F.coalesce(F.greatest(F.array_max(F.map_keys(m)), F.lit(0)), F.lit(0))


# conversion and text
def tonumber(s: Column, base: int = 10) -> Column:
    """A number, or null; other bases read whole numbers."""
    if base == 10:
        hexed = F.conv(F.regexp_extract(s, "^\\s*0[xX]([0-9a-fA-F]+)\\s*$", 1), 16, 10)
        return F.when(s.rlike("^\\s*0[xX][0-9a-fA-F]+\\s*$"), hexed.cast("double")).when(s.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(s).try_cast("double"))
    digits = (_string.digits + _string.ascii_lowercase)[:base]
    return F.when(F.lower(F.trim(s)).rlike(f"^[{digits}]+$"), F.conv(F.trim(s), base, 10).cast("double"))


def _c_number(d: float, digits: int) -> str:
    if math.isnan(d) or math.isinf(d):
        return "nan" if math.isnan(d) else "inf" if d > 0 else "-inf"
    return f"%.{digits}g" % d


def tostring(x: Column) -> Column:
    """A double as the scripting language prints it."""
    return _vectorised(lambda d: _c_number(d, 14), "string")(x.cast("double"))


def format_number(d: float) -> str:
    """Up to eight decimals inside the range of 32-bit integers, else 17 digits."""
    if math.isnan(d) or math.isinf(d) or not -(2**31) <= d <= 2**31 - 1:
        return _c_number(d, 17)
    whole, rest = divmod(abs(d), 1.0)
    scaled = (abs(d) - int(whole)) * 1e8
    part = int(scaled)
    left = scaled - part
    part += left > 0.5 or left == 0.5 and (part == 0 or part % 2 == 1)
    whole = int(whole)
    if part >= 10**8:
        whole, part = whole + 1, 0
    text = f"{whole}.{part:08d}".rstrip("0").rstrip(".")
    return "-" + text if d < 0 else text


def number_text(x: Column) -> Column:
    return _vectorised(format_number, "string")(x.cast("double"))


def escape_binary(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def serialize_double(x: Column) -> Column:
    return F.when(F.isnan(x), "0/0").when(x == float("inf"), "1/0").when(x == float("-inf"), "-1/0").otherwise(_vectorised(lambda d: _c_number(d, 17), "string")(x))


def printable(s: Column) -> Column:
    return F.regexp_replace(s, "[^ -~]", " ")


def unescape(text: str) -> str:
    """Backslash escapes of a script string: letters, up to three digits, and quotes; ValueError for others."""
    simple = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'", "?": "?"}

    def one(m: re.Match) -> str:
        if m[1].isdigit():
            if int(m[1]) > 255:
                raise ValueError(f"invalid escape {m[0]}")
            return chr(int(m[1]))
        if m[1] not in simple:
            raise ValueError(f"invalid escape {m[0]}")
        return simple[m[1]]

    return re.sub(r"\\(\d{1,3}|.?)", one, text, flags=re.S)
