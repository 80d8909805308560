"""Streams neither lose nor invent rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickerlens.operators.prices import latest_prices
from tickerlens.sources.tables import stream_schema
from tickerlens.streaming import jobs as R


def land(spark, path, titles, batch=0):
    arts = [(t, None, "2024-01-02T10:00:00Z", (None,)) for t in titles]
    spark.createDataFrame([(arts, "T00", 0, batch, 0)], R.FEED_FILE_SCHEMA).write.mode("append").json(path)


def run_news(spark, base, ckpt):
    R.start_headlines(spark, f"{base}/in", f"{base}/h", f"{base}/{ckpt}", f"{base}/log",
                      as_of="2024-02-01").awaitTermination()
    return sorted(r[0] for r in spark.read.schema(stream_schema("headlines")).parquet(f"{base}/h")
                  .select("headline").collect())


def ledger(spark, base):
    df = spark.read.schema(R.LEDGER_SCHEMA).parquet(f"{base}/log")
    return sorted((r["inserted"], r["skipped"], r["error"]) for r in df.collect())


def test_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", ["one", "two"])
    assert run_news(spark, base, "c1") == ["one", "two"]
    land(spark, f"{base}/in", ["three"], 1)
    assert run_news(spark, base, "c2") == ["one", "three", "two"]     # old files again, nothing twice
    assert ledger(spark, base) == [(1, 2, None), (2, 0, None)]


def test_empty_first_batch_is_zero_zero(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", ["[Removed]"])
    assert run_news(spark, base, "c1") == []
    assert ledger(spark, base) == [(0, 0, None)]
    land(spark, f"{base}/in", ["real"], 1)
    assert run_news(spark, base, "c1") == ["real"]


def test_failure_rows_stay(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", ["one"])
    long = "boom " * 1000
    state = {"fail": True}

    def body(batch, run, no):
        if state["fail"]:
            raise ValueError(long)
        return R.headline_batch(f"{base}/h", "2024-02-01")(batch, run, no)

    stream = spark.readStream.schema(R.FEED_FILE_SCHEMA).json(f"{base}/in")
    R.open_table(spark, f"{base}/h", "headlines")
    for state["fail"] in (True, False):
        q = R._start(stream, "news_job", f"{base}/c", f"{base}/log", body, None)
        if state["fail"]:
            with pytest.raises(Exception):
                q.awaitTermination()
        else:
            q.awaitTermination()
    rows = spark.read.schema(R.LEDGER_SCHEMA).parquet(f"{base}/log").collect()
    assert sorted((r["inserted"], r["error"] or "") for r in rows) == [(0, long), (1, "")]


def bars(spark, path, rows):
    spark.createDataFrame([(f, "T", dt.date(2024, 1, d), c, c, c, c, 1, None) for f, d, c in rows],
                          R.BAR_FILE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_fetches_in_one_batch_keep_their_own_returns(spark, tmp_path):
    base = str(tmp_path)
    bars(spark, f"{base}/in", [(1, 1, 10.0)])
    bars(spark, f"{base}/in", [(2, 1, 11.0), (2, 2, 12.0)])
    R.start_prices(spark, f"{base}/in", f"{base}/p", f"{base}/c").awaitTermination()
    got = {r["market_date"].day: (r["close"], r["daily_return"])
           for r in spark.read.parquet(f"{base}/p").collect()}
    assert got[1] == (10.0, None)
    assert got[2][0] == 12.0 and math.isclose(got[2][1], math.log(12 / 11))


def test_last_wins_view_has_one_row_per_date(spark, tmp_path):
    base = str(tmp_path)
    for f, c in ((1, 10.0), (2, 11.0)):
        bars(spark, f"{base}/in", [(f, 1, c)])
        R.start_prices(spark, f"{base}/in", f"{base}/p", f"{base}/c", policy="last_wins").awaitTermination()
    rows = latest_prices(spark.read.parquet(f"{base}/p")).collect()
    assert [(r["close"], r["fetch_ord"]) for r in rows] == [(11.0, 2)]


def test_scoring_drains_the_backlog(spark, tmp_path):
    base = str(tmp_path)
    calls = {"limit": 1}

    def scorer(backlog):
        return backlog.orderBy("headline").limit(calls["limit"]).select(
            "headline_hash", F.lit("neutral").alias("sentiment_label"), F.lit(1.0).alias("confidence"),
            F.lit(None).cast("string").alias("attention_keyword"), F.lit("m").alias("model_version"))

    def score(s):
        R.start_scoring(spark, f"{base}/h", f"{base}/s", f"{base}/cs", s, f"{base}/log").awaitTermination()
        return spark.read.schema(stream_schema("scores")).parquet(f"{base}/s").count()

    assert score(scorer) == 0                       # before any headline exists
    land(spark, f"{base}/in", ["one", "two", "three"])
    run_news(spark, base, "c1")
    assert score(None) == 0                         # no model: nothing scored
    land(spark, f"{base}/in", ["four"], 1)
    run_news(spark, base, "c1")
    assert score(scorer) == 1                       # the scorer gives up after one
    calls["limit"] = 100
    land(spark, f"{base}/in", ["five"], 2)
    run_news(spark, base, "c1")
    assert score(scorer) == 5
