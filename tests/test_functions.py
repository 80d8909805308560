"""Golden rows for the scalar functions (FIXTURES.md sections 2.1-2.3,
2.7-2.10)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tickerlens.functions import (attention_keyword, clean_title, decode_logits,
                                  headline_hash, in_trading_hours, label_id,
                                  parse_iso_utc, safe_bigint, safe_double,
                                  session_date, source_of, split_last, title_kept,
                                  title_kept_raw)

AS_OF = "2026-05-16"


def test_session_date_golden(spark):
    cases = [
        ("2026-05-14T13:42:00Z", "2026-05-14"),
        ("2026-05-14T19:59:59Z", "2026-05-14"),
        ("2026-05-14T20:00:00Z", "2026-05-15"),
        ("2026-01-14T20:30:00Z", "2026-01-14"),
        ("2026-01-14T21:00:00Z", "2026-01-15"),
        ("2026-05-15T20:00:00Z", "2026-05-18"),
        ("2026-05-16T02:00:00Z", "2026-05-18"),
        ("2026-05-16T12:00:00Z", "2026-05-18"),
        ("2026-05-17T21:00:00Z", "2026-05-18"),
        ("", AS_OF), (None, AS_OF), ("garbage", AS_OF), ("13:42", AS_OF), ("2026", AS_OF),
        ("20260514T134200Z", "2026-05-14"),
        ("2026-05-14T09:42:00-04:00", "2026-05-14"),
        ("2026-05-14T16:30:00-04:00", "2026-05-15"),
        ("2026-02-30T10:00:00Z", AS_OF),
    ]
    df = spark.createDataFrame(cases, "raw string, want string")
    got = df.select("raw", "want", session_date("raw", AS_OF).cast("string").alias("got")).collect()
    bad = [(r.raw, r.want, r.got) for r in got if r.want != r.got]
    assert not bad, bad


def test_parse_iso_offsets(spark):
    df = spark.createDataFrame([("2026-05-14T13:42:00.5+02:30",), ("2026-05-14 13:42",)], "raw string")
    got = [r[0] for r in df.select(parse_iso_utc("raw")).collect()]
    assert got[0] == dt.datetime(2026, 5, 14, 11, 12, 0, 500000)
    assert got[1] == dt.datetime(2026, 5, 14, 13, 42)


def test_source_golden(spark):
    cases = [
        ("The Verge", "https://x.com/a", "the-verge", "the-verge"),
        (" ", "https://x.com/a", "-", "-"),
        (None, "https://www.reuters.com/a", "reuters.com", "reuters.com"),
        (None, "https://www.wired.com/a", "ired.com", "wired.com"),
        (None, "https://www.site.com:443/a", "site.com:443", "site.com:443"),
        (None, "example.com/x", "", ""),
        (None, None, "newsapi", "newsapi"),
        (None, "", "newsapi", "newsapi"),
        (None, "http://[bad/x", "newsapi", "newsapi"),
    ]
    df = spark.createDataFrame(cases, "name string, url string, c string, p string")
    rows = df.select("c", "p", source_of("name", "url").alias("gc"),
                     source_of("name", "url", "prefix").alias("gp")).collect()
    for r in rows:
        assert (r.gc, r.gp) == (r.c, r.p)


def test_title_filter(spark):
    titles = [None, "", "   ", "[Removed]", " [REMOVED] ", "  Fed holds  ", " NBSP　"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    kept = [r[0] for r in df.select(clean_title("t").alias("c")).filter(title_kept("c")).collect()]
    assert kept == ["Fed holds", "NBSP"]


def test_raw_title_filter_equals_cleaned_filter(spark):
    titles = [None, "", "   ", "[Removed]", " [REMOVED] ", "\u3000[removed]\u00a0", "[removed]x",
              "x[removed]", "[removed] [removed]", "[ removed]", "\n\r\t", "\u2028[removed]\u2029",
              "  Fed holds  ", " NBSP\u3000", "[remove]", "removed", "[REMOVED]\n"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    rows = df.select("t", title_kept(clean_title("t")).alias("a"),
                     title_kept_raw("t").alias("b")).collect()
    for r in rows:
        assert r.a == r.b, r.t


def test_hash_strips_and_is_case_sensitive(spark):
    df = spark.createDataFrame([("X",), ("X ",), ("x",)], "h string")
    hs = [r[0] for r in df.select(headline_hash("h")).collect()]
    assert hs[0] == hs[1] != hs[2]
    import hashlib
    assert hs[0] == hashlib.sha256(b"X").hexdigest()


def test_numeric_guards(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.5,), (3.9,), (-3.9,),
                                (float("inf"),)], "x double")
    rows = df.select(safe_double("x").alias("d"), safe_bigint("x").alias("i")).collect()
    assert [r.d for r in rows][:3] == [None, None, 1.5]
    assert [r.i for r in rows] == [None, None, 1, 3, -3, None]


def test_trading_hours(spark):
    # 2026-05-14 is a Thursday (EDT, UTC-4); 2026-05-16 a Saturday
    cases = [("2026-05-14 13:29:59", False), ("2026-05-14 13:30:00", True),
             ("2026-05-14 19:59:59", True), ("2026-05-14 20:00:00", False),
             ("2026-05-16 16:00:00", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    rows = df.select("want", in_trading_hours(F.col("t").cast("timestamp_ntz")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_split_last_and_label(spark):
    lines = ["Profit rose@positive", "Mail a@b.com now@ Neutral ", "@negative", "odd@mixed"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    b, a = split_last("l")
    rows = df.select(b.alias("s"), label_id(a).alias("lab")).collect()
    assert [(r.s, r.lab) for r in rows] == [("Profit rose", 2), ("Mail a@b.com now", 1),
                                            ("", 0), ("odd", None)]


def test_decode_golden(spark):
    df = spark.createDataFrame(
        [([1.0, 3.0, 2.0], ["[CLS]", "profit", "##s", "rose", "[SEP]", "[PAD]"],
          [[0.9, 0.2, 0.5, 0.3, 0.8, 0.7]], 5),
         ([0.0, 0.0, 0.0], ["[CLS]", "[SEP]", "[PAD]"], [[0.1, 0.2, 0.3]], 2)],
        "logits array<double>, tokens array<string>, att array<array<double>>, n int")
    d = decode_logits("logits")
    rows = df.select(d["label"].alias("l"), d["confidence"].alias("c"),
                     attention_keyword("tokens", "att", "n").alias("k")).collect()
    assert rows[0].l == "neutral"
    assert math.isclose(rows[0].c, 0.6652409557748218, rel_tol=1e-12)
    assert rows[0].k == "s"
    assert rows[1].k is None and rows[1].l == "negative"
