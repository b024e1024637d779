from urllib.parse import quote

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.functions import canonical as C
from annalist.functions import exprs as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("remote", "want"),
    [
        ("git@Example.com:team/app.git", "example.com/team/app"),
        ("https://user:pw@Example.com:8443/team/app.GIT", "example.com/team/app"),
        ("ssh://git@example.com:22//team/app/", "example.com/team/app"),
        ("example.com:team/app", "example.com/team/app"),
        ("/srv/git/app", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize_remote(spark, remote, want):
    assert one(spark, remote, X.normalize_remote) == want


def test_bare_origin(spark):
    assert one(spark, "Example.com/team/app", X.normalize_origin) == "example.com/team/app"
    assert one(spark, "git@h:o/r", X.origin_option) == "https://h/o/r"


def test_urn_segment_is_strict_percent_encoding(spark):
    text = "a b/ü!'()*~-_.:%"
    assert one(spark, text, X.urn_segment) == quote(text, safe="-._~")


def test_compact(spark):
    assert one(spark, " a \t\n b  c ", X.compact) == "a b c"
    assert one(spark, "x" * 501, X.compact) == "x" * 499 + "…"
    assert one(spark, "x" * 500, X.compact) == "x" * 500


def test_lengths(spark):
    assert one(spark, "é😀", X.utf8_bytes) == 6
    assert one(spark, "é😀", X.utf16_units) == 3


def test_validators(spark):
    assert one(spark, "abc\n", X.protocol_id_ok) is False
    assert one(spark, "a.b-c_1", X.protocol_id_ok) is True
    assert one(spark, None, X.memory_id_ok) is False
    assert one(spark, "a\x07", X.host_id_ok) is False
    assert one(spark, "2024-01-01T00:00:00Z", X.timestamp_ok) is True
    assert one(spark, "2024-01-01T00:00:00", X.timestamp_ok) is False


def test_language(spark):
    assert one(spark, "src/A.PY", lambda c: X.in_language(c, "py")) is True
    assert one(spark, "src.py/readme", lambda c: X.in_language(c, "python")) is False
    assert one(spark, "x.h", lambda c: X.in_language(c, "c")) and one(spark, "x.h", lambda c: X.in_language(c, "c++"))


def test_age_and_backoff(spark):
    r = spark.range(1).select(
        X.age_ms(F.lit(5000), F.lit(None).cast("double"), F.lit("1970-01-01T00:00:02Z")).cast("long").alias("a"), X.age_ms(F.lit(0), F.lit(9.0), F.lit(None).cast("string")).cast("long").alias("b"), X.backoff_ms(F.lit(3)).alias("c")
    ).first()
    assert (r.a, r.b, r.c) == (3000, 0, 4000)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"b": [1, 1.0, 333333333.33333329, 1e21, 1e-7, 0.000001, -0.0, 4.5], "a": "é\n "}, '{"a":"é\\n ","b":[1,1,333333333.3333333,1e+21,1e-7,0.000001,0,4.5]}'),
        ({"דּ": 1, "\U0001f600": 2}, '{"\U0001f600":2,"דּ":1}'),
        ([True, None, {}], "[true,null,{}]"),
    ],
)
def test_canonical_json(value, want):
    assert C.canonical_json(value) == want


def test_canonical_json_refuses_lone_surrogates():
    with pytest.raises(C.CanonicalError):
        C.canonical_json({"a": "\ud800"})


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_round_trip(x):
    assert float(C.number_text(x)) == x


def test_fingerprint_ignores_key_order(spark):
    rows = spark.createDataFrame([('{"a":1,"b":[2,{"d":1,"c":2}]}',), ('{"b":[2,{"c":2,"d":1}],"a":1.0}',), ("{",), (None,)], "raw string")
    got = [r.f for r in rows.select(C.fingerprint_column(F.col("raw")).alias("f")).collect()]
    assert got[0] == got[1] == C.fingerprint({"a": 1, "b": [2, {"c": 2, "d": 1}]})
    assert got[2] is None and got[3] is None


def test_compact_records():
    import json

    from annalist.operators.occasions import compact_record

    raw = {"id": "1", "type": "user", "isMeta": True, "extra": [1], "turnOrigin": 5, "toolUseResult": {"agentId": "a", "more": {}}, "message": {"role": "user", "usage": {}, "content": [{"type": "text", "text": "  " + "x" * 511 + "😀" + "y"}, 7]}}
    got = compact_record(json.dumps(raw))
    assert got == {"id": "1", "type": "user", "isMeta": True, "turnOrigin": 5, "originMalformed": True, "toolUseResult": {"agentId": "a"}, "message": {"role": "user", "content": [{"type": "text", "text": "x" * 511}, {}]}}
    assert compact_record(json.dumps({"message": {"role": "assistant", "content": "long"}}))["message"] == {"role": "assistant", "content": None}
    assert compact_record("[1]") is None and compact_record("{") is None


def test_paths_quotes_and_forms(spark):
    import posixpath

    from annalist.functions import exprs as X
    from annalist.operators.evidence import absolute_path
    from pyspark.sql import functions as F

    rows = [("/a/b", "c.py"), ("/a/b", "../c.py"), ("/a", "/x//y/./z"), (None, "k"), ("/a", "../../../q"), ("/a/b/", "./d/../e"), ("/a", "  "), ("/a", None), ("/a/..b", "..c/f..")]
    df = spark.createDataFrame(rows, "c string, p string")
    want = [posixpath.normpath(posixpath.join(c or "/", p)) if p and p.strip() else None for c, p in rows]
    assert [r.x for r in df.select(absolute_path(F.col("c"), F.col("p")).alias("x")).collect()] == want
    odd = spark.createDataFrame([('a"b\n\x7f\u2028é\\',), (None,), ("\u202e",)], "t string")
    assert [r.q for r in odd.select(X.quoted("t").alias("q")).collect()] == ['"a\\"b\\n\\u007f\\u2028é\\\\"', "null", '"\\u202e"']
    forms = spark.createDataFrame([(12.34, "pi", " ", "ann@x.org"), (None, "cc", "", "@x.org"), (5.0, "pi", "p", "none")], "ms double, k string, p string, e string")
    got = [tuple(r) for r in forms.select(X.format_ms("ms"), X.input_producer("k", "p", "dflt"), X.mask_email("e")).collect()]
    assert got == [("12.3 ms", "dflt", "a***@x.org"), ("n/a", "", "***"), ("5 ms", "p", "***")]
