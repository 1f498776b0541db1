import math

import pytest
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from rillet.functions import capture
from rillet.functions import scalar as fn
from rillet.operators import accessors, stats


@pytest.mark.parametrize("d, text", [(10.1, "10.1"), (2147483648.0, "2147483648"), (-2147483649.0, "-2147483649"), (float("nan"), "nan"), (float("inf"), "inf"), (float("-inf"), "-inf"), (0.0, "0"), (1.2, "1.2"), (-1e-12, "-0"), (99.999999999, "100"), (1 / 3, "0.33333333")])
def test_number_text(d, text):
    assert fn.format_number(d) == text


def test_unescape():
    assert fn.unescape(r"a\n\t\\\065\"") == 'a\n\t\\A"'
    for bad in (r"\999", r"\q", "x\\"):
        with pytest.raises(ValueError):
            fn.unescape(bad)


def test_strings(spark):
    df = spark.createDataFrame([("héllo wörld",), ("",), (None,)], "s string")
    got = df.select(fn.length(F.col("s")), fn.upper(F.col("s")), fn.sub(F.col("s"), 1, 1), fn.sub(F.col("s"), -3), fn.byte(F.col("s"), 1), fn.find_plain(F.col("s"), "w"), fn.match(F.col("s"), "(%a+)$"), fn.sub(F.col("s"), 5, 2)).collect()
    assert tuple(got[0]) == (13, "HéLLO WöRLD", "h", "rld", 104, 8, "rld", "")
    assert tuple(got[1]) == (0, "", "", "", None, None, None, "") and tuple(got[2]) == (None,) * 8
    row = spark.range(1).select(fn.gsub(F.lit("hello world"), "o", "<%0>"), fn.gsub(F.lit("k=v"), "(%w+)=(%w+)", "%2=%1$"), fn.gsub_table(F.lit("a b c"), "%a", {"a": "1", "c": "3"}), fn.format("%5.1f|%q|%g", F.lit(3.14159), F.lit('a"b'), F.lit(100.0)), fn.format("%c%i", F.lit(65), F.lit(7))).first()
    assert tuple(row) == ("hell<o> w<o>rld", "v=k$", "1 b 3", '  3.1|"a\\"b"|100', "A7")


def test_maths(spark):
    row = spark.range(1).select(fn.math_function("log", F.lit(-1.0)), fn.math_function("log", F.lit(0.0)), fn.mod(F.lit(-5.5), F.lit(3.0)), fn.fmod(F.lit(-5.5), F.lit(3.0)), fn.divide(F.lit(-1.0), F.lit(0.0)), fn.divide(F.lit(0.0), F.lit(0.0)), fn.modf(F.lit(-2.5))["whole"], fn.erf(F.lit(0.5)), fn.frexp(F.lit(8.0))["exponent"], fn.next_power_of_two(F.lit(17)), stats.greatest(F.lit(1.0), F.lit(float("nan"))), fn.math_function("ceil", F.lit(1e300))).first()
    assert math.isnan(row[0]) and row[1] == -math.inf and row[2:5] == (0.5, -2.5, -math.inf) and math.isnan(row[5])
    assert row[6] == -2.0 and row[7] == pytest.approx(math.erf(0.5)) and row[8:] == (4, 32, 1.0, 1e300)


def test_dates_and_tables(spark):
    t = F.array(F.lit("b"), F.lit("a"))
    row = spark.range(1).select(fn.date("%Y-%m-%d %H:%M:%S%%", F.lit(86399)), fn.time(F.lit(1970), F.lit(1), F.lit(2)), fn.time(F.lit(1970), F.lit(13), F.lit(1), F.lit(0)), fn.concat(fn.sort(t), ","), fn.concat(fn.insert(t, F.lit("c"), 1)), fn.concat(fn.remove(t, 1)), fn.tonumber(F.lit(" 0x1F ")), fn.tonumber(F.lit("zz"), 36), fn.tonumber(F.lit("1e3")), fn.tonumber(F.lit("1x")), fn.tostring(F.lit(0.1) + 0.2)).first()
    assert tuple(row) == ("1970-01-01 23:59:59%", 86400 + 43200, 365 * 86400, "a,b", "cba", "a", 31.0, 1295.0, 1000.0, None, "0.3")
    with pytest.raises(ValueError):
        fn.date("%Q", F.lit(0))


def test_running_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("b", 5.0), ("c", None)], "k string, x double")
    got = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(stats.running_count(F.col("x")), stats.running_mean(F.col("x")), stats.running_sd(F.col("x"))).collect()}
    assert got == {"a": (3, 2.0, 1.0), "b": (1, 5.0, 0.0), "c": (0, 0.0, 0.0)}


def test_accessors(spark):
    from rillet.plans.adapters import event_messages

    with pytest.raises(ValueError):
        accessors.read_message("Bogus")
    with pytest.raises(ValueError):
        accessors.read_message("Fields[a]", -1)
    e = event_messages(spark, "/root/testdata/sf0.001")
    row = e.orderBy("event_id").select(accessors.read_message("Fields[user_id]"), accessors.read_message("Fields[nope]"), accessors.read_number("Fields[value]"), accessors.output(F.lit("a"), F.lit(None), F.lit(True), (F.lit(1.2), "number"))).first()
    assert row[0].isdigit() and row[1] is None and row[2] > 0 and row[3] == "anniltrue1.2".replace("ann", "an")
    with pytest.raises(Exception, match="output_limit"):
        e.select(accessors.output(F.lit("abc"), limit=2)).collect()


@pytest.mark.parametrize("s, pattern, init, want", [
    ("hello world", "o w", 1, (5, 7, [])), ("hello", "l+", -3, (3, 4, [])), ("key = val", "(%w+)%s*=%s*(%w+)", 1, (1, 9, [b"key", b"val"])), ("abc", "()b()", 1, (2, 2, [2, 3])), ("aXb", "^X", 2, (2, 2, [])),
    ("f(a(b)c)d", "%b()", 1, (2, 8, [])), ("x(a)(b)", "(%b())$", 1, (5, 7, [b"(b)"])), ("THE (quick) fox", "%f[%a]%a+%f[%A]", 6, (6, 10, [])), ("abab", "(ab)%1", 1, (1, 4, [b"ab"])), ("abc", "d", 1, None), ("", "", 1, (1, 0, [])), ("a.b", "%.", 1, (2, 2, [])), ("aé", "..$", 1, (2, 3, [])), ("(a", "%b()", 1, None), ("xyz", "((x)(y))z", 1, (1, 3, [b"xy", b"x", b"y"])), ("aaa", "a-$", 1, (1, 3, [])),
])
def test_find(s, pattern, init, want):
    assert capture.find(s.encode(), pattern.encode(), init) == want


def test_substitution():
    sub = lambda *a: capture.gsub(*[x.encode() if isinstance(x, str) else x for x in a])
    assert sub("hello world", "o", "0", 1) == (b"hell0 world", 1) and sub("abc", "%w", "%0%0") == (b"aabbcc", 3) and sub("hello world", "%w*", "x") == (b"xx xx", 4)
    assert sub("aaa", "^a", "Z") == (b"Zaa", 1) and sub("$name is $age", "%$(%w+)", {b"name": "Bo", b"age": 4}) == (b"Bo is 4", 2) and sub("a1b2", "%d", lambda d: int(d) * 2) == (b"a2b4", 2)
    assert sub("(x)(y)", "%b()", "[%0]") == (b"[(x)][(y)]", 2) and sub("ab", "", "-") == (b"-a-b-", 3) and sub("ab", "(a)()", "%2%1") == (b"2ab", 1) and sub("ab", "a", lambda a: None) == (b"ab", 1)
    assert list(capture.gmatch(b"k1=v1, k2=v2", b"(%w+)=(%w+)")) == [[b"k1", b"v1"], [b"k2", b"v2"]] and list(capture.gmatch(b"^a", b"^a")) == [[b"^a"]]
    for bad in ("(", ")", "%", "[a", "%1", "%b", "%fa"):
        with pytest.raises(capture.PatternError):
            capture.compiled(bad.encode())
    with pytest.raises(capture.PatternError):
        sub("a", "a", "%3")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "%d", "[ab]", "[^a]", "%s", "x"]).flatmap(lambda c: st.sampled_from([c, c + "*", c + "-", c + "+", c + "?"])), max_size=4), st.text("ab1 x", max_size=8))
def test_closures_and_expressions_agree(parts, subject):
    """The two ways of matching give the same places."""
    pattern = "".join(parts)
    one = capture.Pattern(pattern.encode())
    other = capture.Pattern(pattern.encode())
    other.regex, other.go = None, capture.closures(list(capture.items(pattern.encode())))
    assert list(one.every(subject.encode())) == list(other.every(subject.encode()))


def test_nulls_and_large_numbers(spark):
    df = spark.createDataFrame([(None, None, None), (2**53 + 1, "é", float("nan"))], "i long, s string, x double")
    got = df.select(fn.format("%d %s", F.col("i"), F.col("s")), fn.frexp(F.col("x")), fn.tostring(F.col("x")), F.hex(fn.reverse(F.col("s"))), fn.find(F.col("s"), "(.)"), fn.match(F.col("s"), "()."), fn.gsub(F.col("s"), ".", "x", 1), fn.modf(F.col("x")), fn.byte_range(F.col("s"), 1, -1)).collect()
    assert tuple(got[0]) == (None,) * 9
    assert got[1][0] == f"{2**53 + 1} é" and got[1][2] == "nan" and got[1][3] == "A9C3" and tuple(got[1][4])[:2] == (1, 1) and got[1][5] == "1" and got[1][8] == [0xC3, 0xA9]
    row = spark.range(1).select(*[fn.next_power_of_two(F.lit(2**k)) for k in (0, 1, 29, 31, 39, 47, 51, 55, 62)], fn.next_power_of_two(F.lit(0)), fn.next_power_of_two(F.lit(2**55 + 1)), fn.modf(F.lit(float("inf")))["fraction"], fn.date("%d apples upper, %e|%C|%z", F.lit(0)), fn.difftime(F.lit(5), F.lit(3))).first()
    assert tuple(row) == (1, 2, 2**29, 2**31, 2**39, 2**47, 2**51, 2**55, 2**62, 0, 2**56, 0.0, "01 apples upper,  1|19|+0000", 2.0)


def test_enrichment(spark):
    from rillet.operators import routing

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    table = spark.createDataFrame([("a", 5, "x"), ("a", 4, "y"), (None, 1, "n")], "name string, v int, w string")
    got = {r.id: (r.v, r.w) for r in routing.enrich(df, table, F.col("k"), {"v": "v", "w": "w"}, "name").collect()}
    assert got == {1: (4, "y"), 2: (None, None), 3: (None, None)}
    assert df.select(F.size(routing.rules_that_hold({}))).first()[0] == 0


def test_header_defaults(spark):
    df = spark.createDataFrame([(None, None, None, 7, "h"), (bytearray(16), 5, "l", None, None)], "uuid binary, timestamp bigint, logger string, pid int, hostname string")
    a, b = accessors.header_defaults(df, {"logger": "cfg", "pid": 1}, F.lit(99)).collect()
    assert (len(a.uuid), a.timestamp, a.logger, a.pid, a.hostname) == (16, 99, "cfg", 7, "h") and (bytes(b.uuid), b.timestamp, b.logger, b.pid, b.hostname) == (bytes(16), 5, "l", 1, None)
