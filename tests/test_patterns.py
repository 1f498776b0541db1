import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillet.functions import luapattern as lp

HIT = [(" ", "."), ("foobar", "foo"), ("foobar", "bar$"), ("7", "%d"), ("f", "%x"), ("\t", "%s"), (",", "%p"), ("%", "%%"), ("b", "[a-c]"), ("d", "[^a-c]"), ("abc", "^%a+$"), ("(", "("), (")", "%)"), ("|foo|", "%b||"), ("a(b(c)d)e", "%b()"), ("]", "]"), ("]", "[]]"), ("-", "[a%-]"), ("abc", "^%a-$"), ("a$c", "a$c"), ("b", "a?b"), ("123ab", "%f[%a]"), ("é", "^..$"), ("é", "é")]
MISS = [("", "."), ("_foo", "^foo"), ("bar_", "bar$"), ("x", "%d"), ("p", "%x"), ("d", "[a-c]"), ("a.", "^%a+$"), ("|foo", "%b||"), ("aa", "(%a)%1*"), ("é", "^.$"), ("E", "e")]
BROKEN = ["[f", "%b|", "%", "x%", "[^", "%f"]


@pytest.mark.parametrize("subject, pattern", HIT)
def test_hit(subject, pattern):
    assert lp.matches(subject.encode(), pattern.encode())


@pytest.mark.parametrize("subject, pattern", MISS)
def test_miss(subject, pattern):
    assert not lp.matches(subject.encode(), pattern.encode())


@pytest.mark.parametrize("pattern", BROKEN)
def test_broken_never_matches(pattern):
    assert not lp.matches(b"", pattern.encode())
    assert lp.translate(pattern).kind == "never"


def test_lonely_repeats_are_literals():
    for c in "?+-*":
        assert not lp.matches(b"", c.encode()) and lp.matches(b"a" + c.encode(), c.encode())


def test_strength_reduction():
    assert lp.translate("abc") == lp.Translation("literal", "abc")
    assert lp.translate("a.c", plain=True).kind == "literal"
    assert lp.translate("^abc").kind == "prefix" and lp.translate("abc$").kind == "suffix"
    assert lp.translate("a%.b$") == lp.Translation("suffix", "a.b")


def test_columns_agree_with_matcher(spark):
    from pyspark.sql import functions as F

    subjects = sorted({s for s, _ in HIT + MISS} | {"", "a\nb", "x" * 300, "漢字", "{" * 20 + "}" * 20, "{" * 20 + "}" * 19, "(a(b)c", "((((((((a))))))))b", "(((((((((a)))))))))b", "é(é(x)y)", "{a" * 8 + "}" * 8, "(" + "a()" * 5000 + ")"})
    df = spark.createDataFrame([(s, bytearray(s.encode())) for s in subjects], "s string, b binary")
    patterns = [p for _, p in HIT + MISS] + BROKEN + ["[%w_]+", "%S-x", "%W", "[^%d%s]", "a*b+c?", ".-$", "^%b{}$", "%b()b", "^.-%b()", "%b()$", "%b{}%b{}", "é%b()", "[^a]%b()y"]
    row = df.select(F.struct("s", *[lp.match(F.col("s"), p).alias(f"s{k}") for k, p in enumerate(patterns)], *[lp.match(F.col("b"), p, binary=True).alias(f"b{k}") for k, p in enumerate(patterns)]).alias("r"))
    for (r,) in row.collect():
        for k, p in enumerate(patterns):
            want = lp.matches(r["s"].encode(), p.encode())
            assert (r[f"s{k}"], r[f"b{k}"]) == (want, want), (r["s"], p)


@settings(max_examples=60, deadline=None)
@given(st.text("ab1-] ", max_size=8), st.lists(st.sampled_from(["a", "%a", "%d", ".", "[a1]", "[^b]", "a*", "%a+", "1-", ".?", "%f[%d]"]), min_size=1, max_size=4), st.booleans(), st.booleans())
def test_translation_as_python_regex(subject, items, start, end):
    import re

    pattern = "^" * start + "".join(items) + "$" * end
    t = lp.translate(pattern)
    want = lp.matches(subject.encode(), pattern.encode())
    if t.kind == "regex":
        assert bool(re.search(t.text.replace("\\z", "\\Z"), subject, re.S)) == want
    elif t.kind in ("literal", "prefix", "suffix"):
        assert {"literal": t.text in subject, "prefix": subject.startswith(t.text), "suffix": subject.endswith(t.text)}[t.kind] == want
