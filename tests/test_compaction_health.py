"""Score compaction beside readers and crashes; health from footers; one-pass
accounting."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_stores import plan
from tickerlens.operators import health as H
from tickerlens.operators.ingest import accounting_by_batch, first_arrivals, ingest_runs
from tickerlens.sources.tables import SCORES, stream_schema
from tickerlens.streaming import compaction as Z
from tickerlens.streaming import stores as S


def write(spark, path, run, no, rows):
    df = spark.createDataFrame([(h, lab, 1.0, None, "m", seq) for h, lab, seq in rows], SCORES)
    S.commit(df, path, "scores", run, no)


def effective(spark, path):
    return {r["headline_hash"]: (r["sentiment_label"], r["score_seq"])
            for r in Z.effective_scores(spark, path).collect()}


def test_compaction_keeps_the_latest_score_of_every_hash(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert effective(spark, path) == {} and Z.compact(spark, path) == 1 and effective(spark, path) == {}
    write(spark, path, "a", 0, [("x", "old", 0), ("y", "only", 0)])
    write(spark, path, "a", 1, [("x", "new", 1)])
    want = {"x": ("new", 1), "y": ("only", 0)}
    assert effective(spark, path) == want
    reader = Z.effective_scores(spark, path)                # planned before the next generation
    assert Z.compact(spark, path) == 2 and effective(spark, path) == want
    write(spark, path, "a", 2, [("z", "fresh", 2), ("y", "changed", 2)])
    want |= {"z": ("fresh", 2), "y": ("changed", 2)}
    assert effective(spark, path) == want                   # commits after it stay visible
    assert Z.compact(spark, path) == 3 and effective(spark, path) == want
    assert {r["headline_hash"]: r["sentiment_label"] for r in reader.collect()} == {"x": "new", "y": "only"}
    one = spark.read.schema(SCORES).parquet(Z.snapshot_path(path, 3))
    assert one.count() == 3
    assert Z.compact(spark, path) == 4 and effective(spark, path) == want


def test_a_crash_leaves_the_generation_before_in_force(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    write(spark, path, "a", 0, [("x", "old", 0)])
    Z.compact(spark, path)
    write(spark, path, "a", 1, [("x", "new", 1), ("y", "one", 1)])
    want = {"x": ("new", 1), "y": ("one", 1)}
    real = Z._write
    for crash_after in (1, 2):                               # covered commits, snapshot, no mark
        calls = []

        def stops(df, p):
            real(df, p)
            calls.append(p)
            if len(calls) == crash_after:
                raise RuntimeError("lost")
        monkeypatch.setattr(Z, "_write", stops)
        with pytest.raises(RuntimeError):
            Z.compact(spark, path)
        assert Z.newest_generation(spark, path) == 1 and effective(spark, path) == want
    monkeypatch.setattr(Z, "_write", real)
    write(spark, path, "b", 0, [("w", "late", 2)])           # the scorer went on meanwhile
    assert Z.compact(spark, path) == 2
    assert effective(spark, path) == want | {"w": ("late", 2)}


def test_commits_made_during_a_compaction_stay_visible(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    write(spark, path, "a", 0, [("x", "old", 0)])
    real = Z._write

    def meanwhile(df, p):
        real(df, p)
        if p.endswith("covered"):
            write(spark, path, "a", 1, [("x", "new", 1)])
    monkeypatch.setattr(Z, "_write", meanwhile)
    Z.compact(spark, path)
    monkeypatch.setattr(Z, "_write", real)
    assert spark.read.schema(SCORES).parquet(Z.snapshot_path(path, 1)).first()["sentiment_label"] == "old"
    assert effective(spark, path) == {"x": ("new", 1)}


def test_totals_come_from_footers(spark, tmp_path):
    path = f"{tmp_path}/h"
    rows = spark.range(1000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("headline_hash"), F.lit("T").alias("ticker"),
        F.lit("t").alias("headline"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("raw_timestamp"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int")).alias("market_date"),
        F.lit(None).cast("timestamp_ntz").alias("published_ts"), F.col("id").alias("batch_id"),
        F.lit(0).alias("ticker_pos"), F.col("id").alias("feed_rank"))
    S.open_table(spark, path, "headlines")
    S.commit(rows, path, "headlines", "r", 0)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    session = H.footer_session(spark)
    total = H.footer_totals(session, path, stream_schema("headlines"), "market_date")
    assert "PushedAggregation: [COUNT(*), MAX(market_date)]" in plan(total)
    assert tuple(total.first()) == (1000, dt.date(2024, 1, 20))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    S.open_table(spark, f"{tmp_path}/none", "scores")
    assert H.footer_totals(session, f"{tmp_path}/none", SCORES).first()["n"] == 0


def test_accounting_equals_runs_one_after_another(spark):
    cols = "headline_hash string, ticker string, headline string, source string, batch_id bigint, ticker_pos int, feed_rank bigint"
    rows = [(f"h{(k * 7) % 23}", "T", "x", None if k % 13 == 0 else "s", k // 10, 0, k % 10) for k in range(120)]
    rows += [rows[5], (None, "T", "x", "s", 3, 0, 99)]
    df = spark.createDataFrame(rows, cols)
    stored, want = set(), {}
    for b in sorted({r[4] for r in rows}):
        mine = [r for r in rows if r[4] == b]
        new = {r[0] for r in mine if r[0] is not None and r[3] is not None} - stored
        stored |= new
        want[b] = (len(new), len(mine) - len(new))
    got = {r["batch_id"]: (r["inserted"], r["skipped"]) for r in accounting_by_batch(df).collect()}
    assert got == want
    runs = ingest_runs(df, F.when(F.col("batch_id") < 5, 1).otherwise(2))
    assert runs.count() == first_arrivals(df).count() == sum(i for i, _ in want.values())
    assert runs.filter("run = 1").count() == sum(i for b, (i, _) in want.items() if b < 5)
    assert plan(accounting_by_batch(df)).count("Scan ExistingRDD") == 1


def test_feed_window_filter_reaches_the_scan(spark):
    from tests.conftest import SF_SMALL
    from tickerlens.plans import common as C
    from tickerlens.sources import driver, feeds
    p = plan(feeds.feed_window(driver.article_rows(spark, SF_SMALL), C.FEED_AS_OF))
    assert "GreaterThanOrEqual(ts,2024-01-13" in p.replace("T00:00", "")
