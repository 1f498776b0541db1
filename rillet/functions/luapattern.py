"""Capture-less Lua patterns over bytes: translated to Java regular expressions, or matched in Python.

A pattern becomes one of: a literal to search, an anchored literal, or a regular
expression. Balanced matches (%b) are regular up to ``DEPTH`` brackets; texts with
more of them, and patterns whose brackets aren't ASCII, go to a Python matcher.
Strings are sequences of bytes. A regular expression whose classes hold only ASCII gives the
same answer on characters; others are applied to the bytes read as Latin-1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = set("^$*+?.[%-")
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER, _UPPER, _DIGIT = range(97, 123), range(65, 91), range(48, 58)
CLASSES = {
    "a": {*_LOWER, *_UPPER}, "c": {*range(32), 127}, "d": {*_DIGIT}, "l": {*_LOWER}, "p": {*_PUNCT}, "s": {32, *range(9, 14)},
    "u": {*_UPPER}, "w": {*_LOWER, *_UPPER, *_DIGIT}, "x": {*_DIGIT, *range(97, 103), *range(65, 71)}, "z": {0},
}
EVERY = frozenset(range(256))
#: Nested brackets that a regular expression tells.
DEPTH = 8


class Malformed(ValueError):
    """The pattern breaks off; it never matches."""


@dataclass(frozen=True)
class Item:
    kind: str  # set, balance, frontier
    chars: frozenset = frozenset()
    repeat: str = ""
    pair: tuple[int, int] = (0, 0)


def class_of(char: int) -> frozenset:
    letter = chr(char)
    found = CLASSES.get(letter.lower())
    if found is None:
        return frozenset({char})
    return frozenset(found) if letter.islower() else EVERY - found


def set_at(p: bytes, at: int) -> tuple[frozenset, int]:
    """The set that begins at the bracket ``at``, and the place after it."""
    k = at + 1
    negated = p[k : k + 1] == b"^"
    k += negated
    begin = k
    while True:  # the first character never ends the set
        if k >= len(p):
            raise Malformed
        k += 2 if p[k] == 0x25 and k + 1 < len(p) else 1
        if k >= len(p):
            raise Malformed
        if p[k] == 0x5D:
            break
    chars, j = set(), begin
    while j < k:
        if p[j] == 0x25 and j + 1 < k:
            chars |= class_of(p[j + 1])
            j += 2
        elif j + 2 < k and p[j + 1] == 0x2D:
            chars |= set(range(p[j], p[j + 2] + 1))
            j += 3
        else:
            chars.add(p[j])
            j += 1
    return (EVERY - chars if negated else frozenset(chars)), k + 1


@lru_cache(4096)
def parse(pattern: bytes) -> tuple[bool, tuple[Item, ...], bool]:
    """Whether it is anchored, its items, and whether it ends with the subject."""
    anchored = pattern[:1] == b"^"
    at, items, end = int(anchored), [], False
    while at < len(pattern):
        c = pattern[at]
        if c == 0x24 and at + 1 == len(pattern):
            end, at = True, at + 1
            continue
        if c == 0x25 and pattern[at + 1 : at + 2] == b"b":
            if at + 3 >= len(pattern):
                raise Malformed
            items.append(Item("balance", pair=(pattern[at + 2], pattern[at + 3])))
            at += 4
            continue
        if c == 0x25 and pattern[at + 1 : at + 2] == b"f":
            if pattern[at + 2 : at + 3] != b"[":
                raise Malformed
            chars, at = set_at(pattern, at + 2)
            items.append(Item("frontier", chars))
            continue
        if c == 0x25:
            if at + 1 >= len(pattern):
                raise Malformed
            chars, at = class_of(pattern[at + 1]), at + 2
        elif c == 0x5B:
            chars, at = set_at(pattern, at)
        else:
            chars, at = (EVERY if c == 0x2E else frozenset({c})), at + 1
        repeat = ""
        if at < len(pattern) and chr(pattern[at]) in "*+?-":
            repeat, at = chr(pattern[at]), at + 1
        items.append(Item("set", chars, repeat))
    return anchored, tuple(items), end


def java_set(chars: frozenset) -> str:
    if not chars:
        return "(?!)"
    ranges, sorted_chars = [], sorted(chars)
    for c in sorted_chars:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{a:02x}" + (f"-\\x{b:02x}" if b > a else "") for a, b in ranges) + "]"


@dataclass(frozen=True)
class Translation:
    """kind: never, literal, prefix, suffix, regex or python; bytewise: the regex is for Latin-1 text.

    opening: brackets of which a text may have ``DEPTH`` at most, or the regex doesn't decide.
    """

    kind: str
    text: str = ""
    bytewise: bool = False
    opening: tuple[str, ...] = ()


def balanced(left: int, right: int) -> str:
    """A regular expression of what is balanced with at most ``DEPTH`` brackets inside one another."""
    x, y = f"\\x{left:02x}", f"\\x{right:02x}"
    if left == right:
        return f"{x}[^{x}]*+{x}"
    inner = f"[^{x}{y}]*+"
    for _ in range(DEPTH - 1):
        inner = f"(?:[^{x}{y}]++|{x}{inner}{y})*+"
    return f"{x}{inner}{y}"


def translate(pattern: str | bytes, plain: bool = False) -> Translation:
    raw = pattern.encode() if isinstance(pattern, str) else pattern
    if plain or not (set(map(chr, raw)) & MAGIC):
        return Translation("literal", raw.decode("utf-8", "surrogateescape"))
    try:
        anchored, items, end = parse(raw)
    except Malformed:
        return Translation("never")
    pairs = [i.pair for i in items if i.kind == "balance"]
    if any(max(p) > 127 for p in pairs):
        return Translation("python")
    single = [i for i in items if i.kind == "set" and len(i.chars) == 1 and not i.repeat]
    if len(single) == len(items) and items and anchored != end:
        text = bytes(next(iter(i.chars)) for i in items)
        try:
            return Translation("prefix" if anchored else "suffix", text.decode())
        except UnicodeDecodeError:
            pass
    out, bytewise = ["\\A" if anchored else ""], False
    for i in items:
        bytewise |= max(i.chars, default=0) > 127
        body = java_set(i.chars)
        if i.kind == "balance":
            out.append(balanced(*i.pair))
        elif i.kind == "frontier":
            rest = java_set(EVERY - i.chars)
            out.append(f"(?<={rest})" if 0 in i.chars else f"(?<!{body})")
            out.append(f"(?={body}|\\z)" if 0 in i.chars else f"(?={body})")
        else:
            out.append(body + {"-": "*?"}.get(i.repeat, i.repeat))
    return Translation("regex", "".join(out) + ("\\z" if end else ""), bytewise, tuple(sorted({f"\\x{a:02x}" for a, b in pairs if a != b})))


def matches(subject: bytes, pattern: bytes, plain: bool = False) -> bool:
    """The matcher itself, for balanced patterns and as the yardstick of the translation."""
    if plain or not (set(map(chr, pattern)) & MAGIC):
        return pattern in subject
    try:
        anchored, items, end = parse(pattern)
    except Malformed:
        return False
    n = len(subject)

    def follow(at: int, k: int) -> bool:
        while k < len(items):
            i = items[k]
            if i.kind == "balance":
                if at >= n or subject[at] != i.pair[0]:
                    return False
                depth, j = 1, at + 1
                while j < n and depth:
                    if subject[j] == i.pair[1]:
                        depth -= 1
                    elif subject[j] == i.pair[0]:
                        depth += 1
                    j += 1
                if depth:
                    return False
                at, k = j, k + 1
            elif i.kind == "frontier":
                before, after = (subject[at - 1] if at else 0), (subject[at] if at < n else 0)
                if before in i.chars or after not in i.chars:
                    return False
                k += 1
            elif i.repeat == "":
                if at >= n or subject[at] not in i.chars:
                    return False
                at, k = at + 1, k + 1
            elif i.repeat == "-":
                while not follow(at, k + 1):
                    if at >= n or subject[at] not in i.chars:
                        return False
                    at += 1
                return True
            else:
                most = at
                while most < n and subject[most] in i.chars and (i.repeat != "?" or most == at):
                    most += 1
                return any(follow(j, k + 1) for j in range(most, at - (i.repeat != "+"), -1))
        return not end or at == n

    return any(follow(at, 0) for at in ([0] if anchored else range(n + 1)))


def udf(pattern: bytes):
    """Arrow-batched matcher for patterns that no regular expression expresses; null stays null."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else matches(bytes(v), pattern)).astype("object")

    return run


def match(column: Column, pattern: str | bytes, plain: bool = False, binary: bool = False) -> Column:
    """Whether ``column`` matches: null for null. ``binary``: the column holds bytes."""
    t = translate(pattern, plain)
    if t.kind == "never":
        return F.when(column.isNotNull(), F.lit(False))
    if t.kind == "python":
        return udf(pattern.encode() if isinstance(pattern, str) else pattern)(column if binary else column.cast("binary"))
    if t.kind == "regex":
        raw = column if binary else column.cast("binary")
        if binary or t.bytewise:
            column = F.decode(raw, "ISO-8859-1")
        found = column.rlike(t.text)
        if not t.opening:
            return found
        deep = reduce(lambda a, b: a | b, [F.regexp_count(column, F.lit(x)) > DEPTH for x in t.opening])
        own = udf(pattern.encode() if isinstance(pattern, str) else pattern)(F.when(deep, raw))  # null for all others
        return F.when(deep, own).otherwise(found)
    text = t.text.encode("utf-8", "surrogateescape")
    needle = F.lit(bytearray(text)) if binary else F.lit(t.text)
    return {"literal": F.contains, "prefix": F.startswith, "suffix": F.endswith}[t.kind](column, needle)
