"""Extraction against Python's own regular expressions, round trips, typed values, and log tables."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsense.functions import textstats, typed
from logsense.functions.extract import extract, may_contain, priority_tokens, restore, skeleton, with_offsets
from logsense.functions.patterns import BY_PRIORITY, FUSED, TYPES
from logsense.operators.logtable import LogTable, QueryBuilder, parse_filter
from logsense.plans import registry

TEXTS = [
    "2024-01-15 10:30:45 ERROR User1 failed from 10.0.0.1", "2024-01-15T10:30:45.123+02:00 INFO ok", "2024-01-15T10:30:45Z INFO", "INFORMATION WARNING x", "{} {0} {P1}", "/tmp/a@b.com",
    "id 550e8400-E29B-41d4-a716-446655440000 at 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "see https://x.org/a?b=c 'q' 0xFF -1.50 007", "", "日本 2024-02-30 10:99:00 é", "a\u0001b\u0002c\u0010d 5\u00016", "tab\tand\r", None,
]


def fused(text):
    return [(TYPES[next(k for k, g in enumerate(m.groups()) if g is not None)], m[0]) for m in re.finditer(FUSED, text or "", re.A)]


def by_priority(text):
    kept = []
    for name, p in BY_PRIORITY:
        for m in re.finditer(p.replace(r"\d", "[0-9]"), text or ""):  # word boundaries know all letters
            if not any(a < m.end() and m.start() < b for a, b, _, _ in kept):
                kept.append((m.start(), m.end(), name, m[0]))
    return sorted(kept)


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")


def check(spark, texts):
    x = extract(frame(spark, texts)).select("k", "text", "tokens", skeleton(F.col("literals")).alias("s"), restore(F.col("literals"), F.col("tokens")).alias("r"), with_offsets(F.col("literals"), F.col("tokens")).alias("o"), priority_tokens(F.col("text")).alias("p"))
    for r in x.collect():
        assert [(t.ptype, t.text) for t in r.tokens] == fused(r.text)
        assert r.r == (r.text or "")
        raw = (r.text or "").encode()
        assert all(raw[t.start : t.end] == t.text.encode() for t in r.o)
        if not re.search("[\x01\x02\x10]", r.text or ""):
            assert [(t.start, t.end, t.ptype, t.text) for t in r.p] == by_priority(r.text)


def test_texts(spark):
    check(spark, TEXTS)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["2024-01-02", "T", " ", "10:11:12", ".5", "ERROR", "1.2.3.4", "a@b.co", "/x/y", "0x1f", "{", "}", "é", "\r", "http://q", "-", "7"]), max_size=12).map("".join), min_size=5, max_size=30))
def test_random(spark, texts):
    check(spark, texts)


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    check(spark, texts)


def test_typed(spark):
    rows = ["2024-01-15 10:30:45", "2024-01-15T10:30:45.123456", "2024-01-15T10:30:45+02:00", "2024-01-15T10:30:45-0130", "2024-01-15T10:30:45Z", "2024-02-30 10:30:45", "2024-01-15 10:30:45+01:00", None]
    got = [r.v for r in frame(spark, rows).orderBy("k").select(typed.timestamp_ms(F.col("text")).alias("v")).collect()]
    base = 1705314645000
    assert got == [base, base + 123, base - 7_200_000, base + 5_400_000, None, None, None, None]
    one = lambda f, t: frame(spark, [t]).select(f(F.col("text")).alias("v")).first().v
    assert [one(typed.ipv4, t) for t in ("0.0.0.0", "255.255.255.255", "01.2.3.4")] == [0, 4294967295, 0]
    assert [one(typed.level, t) for t in ("TRACE", "warning", "Critical", "what")] == [0, 3, 6, 7]
    assert [one(typed.number_text, t) for t in ("007", "1.50", "42")] == ["7", "1.50", "42"]
    assert one(typed.uuid, "550E8400-e29b-41d4-a716-446655440000") == "550e8400e29b41d4a716446655440000" and one(typed.uuid, "xyz") is None
    assert one(typed.time_ms, "10:30:45.5") == 37845500 and one(typed.time_ms, "25:00:00") is None
    assert one(typed.date_days, "1970-01-02") == 1 and one(typed.date_days, "1969-12-31") is None


def test_rendered(spark):
    one = lambda f, t: frame(spark, [t]).select(f(F.col("text")).alias("v")).first().v
    v6 = {"2001:0db8:0000:0000:0001:0000:0000:0001": "2001:db8::1:0:0:1", "0:0:0:0:0:0:0:0": "::", "0:0:0:0:0:0:0:1": "::1", "fe80:0:0:0:0:0:0:0": "fe80::", "1:0:2:0:3:0:4:0": "1:0:2:0:3:0:4:0", "0:0:0:0:0:ffff:0102:0304": "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8"}
    assert {t: one(lambda c: typed.ipv6_text(typed.ipv6(c)), t) for t in v6} == v6
    times = {"10:30:45": "10:30:45", "10:30:45.5": "10:30:45.500", "00:00:00.0004": "00:00:00"}
    assert {t: one(lambda c: typed.time_text(typed.time_ms(c)), t) for t in times} == times
    stamps = {"2024-01-15 10:30:45.123": "2024-01-15 10:30:45", "2024-01-15T10:30:45": "2024-01-15T10:30:45", "2024-01-15T10:30:45-0130": "2024-01-15T10:30:45-01:30", "2024-01-15T10:30:45Z": "2024-01-15T10:30:45Z"}
    assert {t: one(typed.timestamp_text, t) for t in stamps} == stamps
    assert one(lambda c: typed.date_text(typed.date_days(c)), "2024-02-29") == "2024-02-29"


def test_extracted_once(spark):
    for df in (LogTable(lines(spark)).query(["ipv4"], "log_levels", "=", "ERROR"), LogTable(lines(spark)).tokens("ipv4")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == 1


def lines(spark):
    text = ["A: INFO", "B: ERROR 10.0.0.1", "2024-01-01 00:00:00 WARNING 10.0.0.2 and 10.0.0.3"]
    return spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line_no long, text string")


def test_log_table(spark):
    t = LogTable(lines(spark))
    assert [(r.line_no, r.ipv4) for r in t.query(["ipv4"], "log_levels", "=", "ERROR").collect()] == [(1, "10.0.0.1")]
    assert [(r.ord, r.ipv4) for r in t.query(["ipv4"], "log_levels", "=", "ERROR", mode="positional").collect()] == [(1, "10.0.0.2")]
    assert sorted((r.ord, r.log_levels, r.ipv4) for r in t.select_columns("log_levels", "ipv4", mode="positional").collect()) == [(0, "INFO", "10.0.0.1"), (1, "ERROR", "10.0.0.2"), (2, "WARN", "10.0.0.3")]
    assert [r.log_levels for r in t.select_at("log_levels", [2, 0, 2, 9]).orderBy("pos").collect()] == ["WARN", "INFO", "WARN"]
    assert QueryBuilder(t).select("log_levels").where("log_levels >= WARN").limit(1).run().first().line_no == 1
    for bad in (lambda: t.select_columns("nope"), lambda: t.filter("ipv4", "=", "x"), lambda: t.filter("timestamps", "=", "soon"), lambda: parse_filter("nothing")):
        with pytest.raises(ValueError):
            bad()
    assert parse_filter("urls ~ a=b") == ("urls", "~", "a=b") and parse_filter("numbers>= 3") == ("numbers", ">=", "3")


def test_plan_is_narrow(spark):
    plan = LogTable(lines(spark)).query(["ipv4"], "log_levels", "=", "ERROR")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_required(spark):
    """A type is sought where its tokens are, and not in plain prose."""
    samples = [("TIMESTAMP", "2024-01-15 10:30:45"), ("TIMESTAMP", "2024-01-15T10:30:45Z"), ("UUID", "550e8400-E29B-41d4-a716-446655440000"), ("EMAIL", "a@b.co"), ("URL", "http://x"), ("URL", "https://x"), ("IPV6", "1:2:3:4:5:6:7:8"), ("IPV4", "1.2.3.4"), ("IPV4", "255.255.255.255"), ("DATE", "2024-01-15"), ("TIME", "10:30:45"), ("PATH", "/a"), ("HEX", "0xf"), ("NUMBER", "7"), *[("LOGLEVEL", x) for x in ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "TRACE", "CRITICAL")]]
    for name, text in samples:
        assert re.fullmatch(dict(BY_PRIORITY)[name], text)
        r = frame(spark, [text, "plain prose, without any."]).orderBy("k").select(may_contain(F.col("text"), name).alias("v")).collect()
        assert [x.v for x in r] == [True, False]


def test_priority_tokens_once(spark):
    """Matches of a text are sought once, for statistics as for replacing."""
    texts = ["7 a@b.co 10.0.0.1", "8 9 7", "a@b.co", None, "10 11 12 13"]
    learned = textstats.learn(frame(spark, texts), ["k"])
    got = {r.ptype: (r["count"], r.examples) for r in learned.collect()}
    assert got == {"NUMBER": (8, ["7", "8", "9", "10", "11"]), "EMAIL": (2, ["a@b.co"]), "IPV4": (1, ["10.0.0.1"])}
    for df in (learned, registry.QUERIES["patterns_roundtrip"](spark, "/root/testdata/sf0.001")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == len(BY_PRIORITY)


def test_positional_counts_ordinals_once(spark):
    """The filter and the columns come from the same ordinals: lines are extracted for them and for their bases, not for each twice."""
    out = LogTable(lines(spark)).query(["ipv4", "log_levels"], "log_levels", "!=", "INFO", mode="positional")
    assert sorted(out.collect()) == [("f", 1, "10.0.0.2", "ERROR"), ("f", 2, "10.0.0.3", "WARN")]
    assert out.columns == ["file", "ord", "ipv4", "log_levels"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
