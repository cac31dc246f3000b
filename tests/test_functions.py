"""Times, streams and ingest against plain expectations, on the driver and in columns."""

import json

import pytest
from pyspark.sql import functions as F

from stratalog.functions.streams import parse_stream_tags, parse_stream_tags_column, stream_id, stream_id_column
from stratalog.functions.times import day_overlaps, format_ns, format_ns_column, parse_time, parse_time_column
from stratalog.operators.output import to_ndjson
from stratalog.sources.ingest import decode_entries, decode_lines, normalise

TIMES = [
    ("2026-03-19T10:00:00Z", 1773914400 * 10**9), ("2026-03-19T10:00:00.123456789Z", 1773914400123456789), ("2026-03-19T12:00:00+02:00", 1773914400 * 10**9), (" 5 ", 5 * 10**9),
    ("999999999999", 999999999999 * 10**9 if 999999999999 * 10**9 < 2**63 else None), ("1000000000000", 10**12), ("1773914400123456789", 1773914400123456789), ("-5", -5 * 10**9), ("", None),
]
BAD = ["2026-03-19", "2026-03-19 10:00:00", "2026-03-19T10:00:00", "x", "1.5", "2026-13-01T00:00:00Z", "9999-01-01T00:00:00Z"]


def test_parse_time(spark):
    rows = spark.createDataFrame([(t,) for t, _ in TIMES] + [(b,) for b in BAD], "t string").select("t", parse_time_column(F.col("t")).alias("ns")).collect()
    found = {r["t"]: r["ns"] for r in rows}
    for text, ns in TIMES:
        assert found[text] == ns, text
        if ns is not None or not text:
            assert parse_time(text) == ns
    for text in BAD:
        assert found[text] is None, text
        with pytest.raises(ValueError):
            parse_time(text)


def test_format_time(spark):
    for ns in (0, 1, 10**9, 1773914400123456789, 1773914400120000000, -1):
        assert spark.range(1).select(format_ns_column(F.lit(ns))).first()[0] == format_ns(ns)
    assert format_ns(1773914400120000000) == "2026-03-19T10:00:00.12Z"
    assert day_overlaps("20260319", parse_time("2026-03-19T23:59:59.999999999Z"), None) and not day_overlaps("20260319", parse_time("2026-03-20T00:00:00Z"), None)


def test_streams(spark):
    ids = ["", "_default", "host=h=1,service=a,b,=z,service=c", "a", "x=", "service=api"]
    rows = spark.createDataFrame([(i,) for i in ids], "s string").select("s", parse_stream_tags_column(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == {i: parse_stream_tags(i) for i in ids}
    assert parse_stream_tags(ids[2]) == {"host": "h=1", "service": "c"}
    for entry in ({"service": "api", "host": "h1"}, {"service": ""}, {}, {"host": "z"}):
        columns = {f: F.lit(entry.get(f)).cast("string") for f in ("service", "host")}
        assert spark.range(1).select(stream_id_column(columns)).first()[0] == stream_id(("service", "host"), entry)


def test_decode():
    assert len(decode_entries('{"a":"1"}{"a":"2"}\n{"b":3}')) == 3
    assert decode_entries('[{"_msg":"m","n":1000000,"b":true,"o":{"x":1},"l":[1,2],"z":null}]') == [(None, {"_msg": "m", "n": "1000000", "b": "true", "o": '{"x":1}', "l": "[1,2]"})]
    assert decode_entries('{"_time":5.9}')[0][0] == 5 * 10**9 and decode_entries('{"_time":"1000000000000"}')[0][0] == 10**12
    for bad in ("", "[]", ' [{"a":1}]', '{"a":1}x', '{"_time":null}', '{"_time":true}', '[1]', '{"_time":"nope"}'):
        with pytest.raises(ValueError):
            decode_entries(bad)


def test_normalise():
    row = normalise(None, {"": "x", "e": "", "_stream": "forged", "_time": "1", "service": "api", "k": "v"}, ("service", "host"), 7)
    assert row == {"_time_ns": 7, "_stream": "service=api", "_msg": "missing _msg", "tag_service": "api", "tag_host": None, "fields": {"k": "v"}}


def test_lines_agree_with_request_bodies(spark):
    lines = ['{"_msg":"a<b","_time":"2026-03-19T10:00:00.5Z","service":"s","k":"v"}', '{"_time":12,"n":1,"host":"h","host":"g"}', '{"_msg":"x","_time":"12","_stream":"no","o":{"_time":"9"}}']
    rows = decode_lines(spark.createDataFrame([(x,) for x in lines], "value string"), ("service", "host")).collect()
    for line, row in zip(lines, rows):
        [(t, f)] = decode_entries(line)
        expected = normalise(t, f, ("service", "host"), 0)
        assert {k: row[k] for k in expected} == expected
    out = to_ndjson(decode_lines(spark.createDataFrame([(lines[0],)], "value string"), ("service", "host")), ("service", "host")).first()[0]
    assert json.loads(out) == {"_msg": "a<b", "_stream": "service=s", "_time": "2026-03-19T10:00:00.5Z", "service": "s", "k": "v"}
    for bad in ('{"a":', '{"_time":"nope"}', '{"_time":true}'):
        with pytest.raises(Exception):
            decode_lines(spark.createDataFrame([(bad,)], "value string"), ("service",)).collect()
