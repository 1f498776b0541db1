import pytest
from pyspark.sql import functions as F

from rillet.operators import matcher as matcher_module
from rillet.operators.matcher import Both, Flat, MatcherSyntaxError, matched, matcher, parse
from rillet.schema import MESSAGE_DDL, message

FULL = message(
    [
        {"name": "foo", "value": "bar"},
        {"name": "number", "value": 64, "value_type": 2},
        {"name": "bytes", "value": b"data"},
        {"name": "int", "value": [999, 1024], "value_type": 2},
        {"name": "double", "value": 99.9},
        {"name": "bool", "value": True},
        {"name": "foo", "value": "alternate"},
        {"name": "Payload", "value": "name=test;type=web;"},
        {"name": "when", "value": "Mon Jan 02 15:04:05 -0700 2006", "representation": "date-time"},
        {"name": "zero", "value": 0, "value_type": 2},
        {"name": "string", "value": "43"},
        {"name": "nan", "value": float("nan")},
    ],
    uuid=bytes.fromhex("230081dc326f4e3f9a5a9386a37e246f"), timestamp=1428773426113040228, type="TEST", logger="prober-3", severity=6,
    payload="A payload with a longer text and a unique-item", env_version="0.8", pid=32157, hostname="box-1",
)
BARE = message(uuid=bytes(range(16)))
HOLDS = """
TRUE | Severity == 6 | Severity != 5 | Severity < 7 | Severity >= 6 | Pid == 32157 | Pid != NIL | Type == "TEST" | Type != 'test' | Timestamp > 0
Timestamp == 1428773426113040228 | Timestamp > '2015-04-11T17:30:26Z' | Timestamp < '2015-04-11T17:30:26.114Z' | Timestamp < 1.428773426999e18
Timestamp > '2015-04-11T10:30:26-07:00' | EnvVersion > '0.7' | EnvVersion <= '0.8' | EnvVersion < '0.9' | Hostname != '' | Uuid > '#' | Uuid < '\\\\\\\\'
Fields[foo] == 'bar' | Fields[foo][1] == 'alternate' | Fields[foo][1][0] =~ '^alt' | Fields[foo] < 'barx' | Fields[foo] != 'bara' | Fields[bytes] == 'data'
Fields[int] == 999 | Fields[int][0][1] == 1024 | Fields[int][0][2] == NIL | Fields[int] != NIL | Fields[missing] == NIL | Fields[double] == 99.9
Fields[bool] == TRUE | Fields[bool] != FALSE | Fields[zero] == FALSE | Fields[foo][255] == NIL | Fields[Payload] =~ 'name=%w+' | Fields[when] =~ ' -0700'%
Type =~ 'ST$' | Type !~ '^te' | Type =~ '^TE' | Payload =~ 'unique%-item' | Payload =~ 'unique-item'% | Fields[nan] != 3 | Logger == 'prober-3' || FALSE && FALSE
(Pid == 1 || Logger =~ '^prober') && Type >= 'TEST' | Type == 'x' && Severity == 6 || Logger == 'prober-3'
"""
FAILS = """
FALSE | Timestamp == 1e9 | Timestamp > '2015-04-11T17:30:27Z' | Severity > 6 | Severity != 6 | Type =~ 'Test' | Type !~ 'TEST' | EnvVersion != '0.8'
Fields[foo] == 'ba' | Fields[foo][1] == 'bar' | Fields[foo][0][1] == 'bar' | Fields[bool] == FALSE | Fields[bool] != TRUE | Fields[int] =~ '999' | Fields[zero] == '0'
Fields[string] == 43 | Fields[missing] != NIL | Fields[missing] != 'x' | Fields[missing] !~ 'x' | Fields[int] == NIL | Fields[nan] > 1 | Fields[nan] == 1 | Fields[bool] == 1
Type == 'TEST' && (Severity == 7 || Payload == 'x') | Payload =~ 'not.found'% | Pid == NIL | Uuid > '\\\\\\\\' | Logger =~ '.' && Type =~ '^other' | Fields[bool] > 'a'
"""
BARE_HOLDS = "Type == NIL | Type != '' | Type < '' | Type <= '' | Type !~ '.' | Logger == NIL | Pid == NIL | Pid < 0 | Pid != 3 | Severity == 7 | Fields[x] == NIL"
BARE_FAILS = "Type != NIL | Type == '' | Type > '' | Type >= '' | Type =~ '.' | Type == '%b()' | Pid > 0 | Pid == 0 | Hostname =~ 'x' | Payload != NIL | Fields[x] != NIL"
BROKEN = ["", "bogus", "Type = 'a'", "Pid == 'a'", "Type == 'a' && (Pid == 1", "Fields[]", "Fields[a]", "Fields[a][] == 1", "Fields[a][x] == 1", "Fields[a][0][0][0] == 1", "Fields[a][256] == 1", "Pid =~ '6'", "Type =~ 'a", "Type != 'a\"", "NIL", "Type > NIL", "Uuid == NIL", "Severity == NIL", "Timestamp == NIL", "TRUE FALSE", "Timestamp == '20150411T173026'", "Payload =~ 'foo'i", "Type == '" + "a" * 256 + "'", " && ".join(["TRUE"] * 129), r"Uuid < '\'", "Severity == 007", "Fields[a] > TRUE", "Type == 'a\0'"]


def split(text):
    return [x.strip().replace("\\\\\\\\", "\\\\") for line in text.strip().splitlines() for x in line.split(" | ")]


@pytest.mark.parametrize("rows, holds, fails", [(FULL, split(HOLDS), split(FAILS)), (BARE, split(BARE_HOLDS), split(BARE_FAILS))])
def test_truth_tables(spark, rows, holds, fails):
    df = spark.createDataFrame([rows], MESSAGE_DDL)
    got = df.select(F.array(*[matched(e) for e in holds]).alias("h"), F.array(*[matched(e) for e in fails]).alias("f")).first()
    assert [e for e, ok in zip(holds, got.h) if not ok] == []
    assert [e for e, ok in zip(fails, got.f) if ok] == []


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    with pytest.raises(MatcherSyntaxError):
        parse(text)


def test_limits():
    parse(" && ".join(["TRUE"] * 128))
    parse("Type == '" + "a" * 255 + "'")
    assert parse("Fields[a][255][206] == 1").fi == 255


def test_white_space_and_quotes():
    assert parse("Type=='a'&&Pid==1") == parse(" Type == 'a' \r\n\t&& Pid == 1 ")
    assert parse(r"""Type == 'it\'s \n'""").value == r"it's \n"


def shape(t):
    return t.variable if isinstance(t, matcher_module.Test) else f"({shape(t.left)}{t.op}{shape(t.right)})"


def test_compatibility():
    expression = "TRUE && (FALSE || Severity == 1) || Pid == 2"
    assert shape(parse(expression)) == "((TRUE&&(FALSE||Severity))||Pid)"
    assert shape(parse(expression, compat=True)) == "(TRUE&&((FALSE||Severity)||Pid))"
    assert shape(parse("(TRUE || (FALSE && Pid == 1) || Pid == 2) && Type == 'a'", compat=True)) == "(TRUE||(((FALSE&&Pid)||Pid)&&Type))"
    plain = "TRUE && Pid == 1 || Severity == 1"
    assert parse(plain) == parse(plain, compat=True)
    with pytest.raises(MatcherSyntaxError):
        parse("Fields[a][206] == 1", compat=True)
    tree = parse("Fields[a][1] == 1 && Fields[b] == 2", compat=True)
    assert isinstance(tree, Both) and tree.right.fi == 1 and parse("Fields[a][1] == 1 && Fields[b] == 2").right.fi == 0
    east = "Timestamp > '2020-01-01T00:00:00+0100'"
    assert parse(east, compat=True).value - parse(east).value == 7200e9


def test_pushdown(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = spark.range(10).selectExpr("'a' as type", "cast(id as int) as severity", "id * 1000000000000000000 div 3 as timestamp", "cast(null as string) as logger", "id as f_n", "cast(id as double) as f_d")
    df.write.parquet(str(tmp_path / "t"))
    flat = Flat({"n": ("f_n", 2), "d": ("f_d", 3)})
    plan = spark.read.parquet(str(tmp_path / "t")).where(matcher("Type =~ 'abc' && Severity <= 3 && Logger != 'x' && Timestamp > 1.7e18 && Fields[n] > 3 && Fields[d] < 5", flat))
    text = plan._jdf.queryExecution().executedPlan().toString()
    for part in ("StringContains(type,abc)", "LessThanOrEqual(severity,3)", "Or(IsNull(logger),Not(EqualTo(logger,x)))", "GreaterThanOrEqual(timestamp,", "GreaterThanOrEqual(f_n,", "LessThan(f_d,5.0)"):
        assert part in text, (part, text)


def test_flat_agrees_with_nested(spark):
    from rillet.plans.adapters import FLAT, event_messages, events

    sf = "/root/testdata/sf0.001"
    for e in ("Fields[value] > 50 && Fields[even] == TRUE", "Fields[k] != 7 || Fields[user_id] <= 30.5", "Fields[k][0][1] == NIL", "Fields[value] == 'x'"):
        a = events(spark, sf).where(matcher(e, FLAT)).select("event_id")
        b = event_messages(spark, sf).where(matcher(e)).select("event_id")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_one_message_and_rows_agree(spark):
    """The matcher of plugins says of each message what the column says of its row."""
    from rillet.operators.matcher import MessageMatcher
    from rillet.plans import catalog
    from rillet.plans.adapters import event_messages

    e = event_messages(spark, "/root/testdata/sf0.001").limit(60)
    texts = [text for text, _ in catalog.MATCHES.values()]
    rows = e.select("*", *[matched(t).alias(f"m{k}") for k, t in enumerate(texts)]).collect()
    for k, text in enumerate(texts):
        own = MessageMatcher(text)
        for r in rows:
            m = r.asDict(recursive=True)
            assert own.eval(m) == m[f"m{k}"], text
