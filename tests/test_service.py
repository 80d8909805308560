"""Jobs side by side, bounded dedup, newest rows, broken responses."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_stores import partitions_read
from tests.test_streaming import bars, land
from tickerlens.sources import feeds
from tickerlens.streaming import jobs as R
from tickerlens.streaming import service as V
from tickerlens.streaming import stores as S


def score_all(backlog):
    return backlog.select("headline_hash", F.lit("neutral").alias("sentiment_label"), F.lit(1.0).alias("confidence"),
                          F.lit(None).cast("string").alias("attention_keyword"), F.lit("m").alias("model_version"))


def test_one_job_fails_while_two_go_on(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", ["one", "two"])
    bars(spark, f"{base}/bars", [(1, d, 10.0 + d) for d in (1, 2, 3)])
    service = V.Service(spark, f"{base}/events", restarts=2)
    log = f"{base}/log"
    service.add("news_job", lambda: R.start_headlines(spark, f"{base}/in", f"{base}/h", f"{base}/c1", log,
                                                      as_of="2024-02-01"))
    service.add("price_job", lambda: R.start_prices(spark, f"{base}/bars", f"{base}/p", f"{base}/c2", log))

    def broken(backlog):
        raise ValueError("no model here")
    service.add("scoring_job", lambda: R.start_scoring(spark, f"{base}/h", f"{base}/s", f"{base}/c3", broken, log,
                                                       source=f"{base}/in"))

    def never_starts():
        raise OSError("no such source")
    service.add("fourth_job", never_starts)
    jobs = service.run()
    assert {n: j.failures for n, j in jobs.items()} == {
        "news_job": 0, "price_job": 0, "scoring_job": 3, "fourth_job": 3}
    assert all("no model here" in e for e in jobs["scoring_job"].errors)
    rows = R.read_ledger(spark, log).collect()
    assert sorted((r["job_name"], r["inserted"]) for r in rows if r["error"] is None) == [
        ("news_job", 2), ("price_job", 3)]
    assert [r["job_name"] for r in rows if r["error"]] == ["scoring_job"] * 3
    events = V.read_events(spark, f"{base}/events").collect()
    kinds = {}
    for r in sorted(events, key=lambda r: r["seq"]):
        kinds.setdefault(r["job"], []).append(r["kind"])
    assert kinds["news_job"][0] == kinds["price_job"][0] == "started"
    assert kinds["news_job"][-1] == kinds["price_job"][-1] == "ended"
    assert kinds["scoring_job"].count("started") == kinds["scoring_job"].count("failed") == 3
    assert sum(r["input_rows"] or 0 for r in events if r["job"] == "news_job") >= 1
    assert all("no model here" in r["error"] for r in events if r["kind"] == "failed")
    # the failed job goes on from its checkpoint once it is mended
    again = V.Service(spark, f"{base}/events")
    again.add("scoring_job", lambda: R.start_scoring(spark, f"{base}/h", f"{base}/s", f"{base}/c3", score_all, log,
                                                     source=f"{base}/in"))
    assert again.run()["scoring_job"].failures == 0
    assert R.open_table(spark, f"{base}/s", "scores").count() == 2
    assert not spark.streams.active


def test_monitor_writes_notes_once(spark, tmp_path):
    m = V.Monitor()
    m._note("a", "q", "r", "started")
    m.flush(spark, f"{tmp_path}/e")
    m.flush(spark, f"{tmp_path}/e")
    m._note("a", "q", "r", "ended")
    assert m.heard("q", "r") and not m.heard("q", "x")
    m.flush(spark, f"{tmp_path}/e")
    assert [r["kind"] for r in V.read_events(spark, f"{tmp_path}/e").orderBy("seq").collect()] == ["started", "ended"]
    assert V.job_of(V.query_name("news_job")) == "news_job" and V.job_of(None) == "unnamed"


def feed(spark, rows, batch):
    """One response with (title, day of January or None)."""
    arts = [(t, None, d and f"2024-01-{d:02d}T10:00:00Z", (None,)) for t, d in rows]
    return spark.createDataFrame([(arts, "T00", 0, batch, 0)], R.FEED_FILE_SCHEMA)


def test_bounded_dedup_forgets_old_sessions_only(spark, tmp_path):
    table = f"{tmp_path}/h"
    body = R.bounded_batch(table, "2024-01-31", span_days=5)
    assert body(feed(spark, [("a", 2), ("b", 9), ("none", None), ("a", 3)], 0), "r", 0).inserted == 3
    # earliest session 10: looks back to 5, so b is known and a is forgotten
    got = body(feed(spark, [("a", 10), ("b", 10), ("a", 11), ("none", None)], 1), "r", 1)
    assert (got.inserted, got.skipped) == (1, 3)
    assert body(feed(spark, [("a", 10), ("b", 10), ("a", 11), ("none", None)], 1), "r", 1).inserted == 1   # replay
    rows = {(r["headline"], r["batch_no"]): r["market_date"].day
            for r in R.open_table(spark, table, "headlines").collect()}
    assert rows == {("a", 0): 2, ("b", 0): 9, ("none", 0): 31, ("a", 1): 10}
    known = S.recent_keys(spark, table, ("headline_hash",), dt.date(2024, 1, 9), "other", 0)
    assert partitions_read(known) == 3
    assert body(feed(spark, [], 2), "r", 2) == S.Counts()


def test_newest_rows_reads_the_newest_commits_only(spark, tmp_path):
    base = str(tmp_path)
    ledger, when = [], 0
    body = R.headline_batch(f"{base}/h", "2024-02-01")
    for k in range(6):
        n = body(feed(spark, [(f"title {k} {j}", k + 1) for j in range(3 * (k != 4))], k), "r", k).inserted
        ledger.append((f"2024-01-01T00:00:{k:02d}Z", "r", k, n, None))
    ledger.append(("2024-01-01T00:01:00Z", "r", 9, 0, "boom"))
    rows = spark.createDataFrame(ledger, "ran_at string, run string, batch_no bigint, inserted bigint, error string")
    order = ["batch_id", "ticker_pos", "feed_rank"]
    got = S.newest_rows(spark, f"{base}/h", "headlines", rows, 4, order)
    assert [r["headline"] for r in got.collect()] == ["title 5 2", "title 5 1", "title 5 0", "title 3 2"]
    assert partitions_read(S.newest_rows(spark, f"{base}/h", "headlines", rows, 4, order)) == 2
    assert S.newest_rows(spark, f"{base}/h", "headlines", rows, 100, order).count() == 15
    assert S.newest_rows(spark, f"{base}/h", "headlines", rows.limit(0), 5, order).count() == 0


GOOD = {"ticker": "T00", "ticker_pos": 0, "batch_id": 0, "page": 0,
        "articles": [{"title": "good", "publishedAt": "2024-01-02T10:00:00Z", "url": None, "source": {"name": None}}]}
LINES = [json.dumps(GOOD), json.dumps(GOOD)[:-9], '{"articles": [{"title": "x"', "<html>busy</html>",
         json.dumps({"ticker": "T00", "ticker_pos": 0, "batch_id": 0, "page": 1})]


def test_broken_responses_are_told_apart(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*LINES, "", "   ", None])], "id int, value string")
    good, aside = feeds.split_feed(feeds.checked_feed(df))
    assert {r["id"] for r in good.collect()} == {0, 4}
    assert [r["title"] for r in feeds.explode_articles(good).collect()] == ["good"]
    assert {r["id"]: (r["reason"], r["text"]) for r in aside.collect()} == {
        1: ("malformed", LINES[1]), 2: ("malformed", LINES[2]), 3: ("malformed", LINES[3]),
        5: ("empty", ""), 6: ("empty", "   "), 7: ("empty", None)}


@pytest.mark.parametrize("quarantine", [False, True])
def test_stream_puts_broken_responses_aside(spark, tmp_path, quarantine):
    base = str(tmp_path)
    os.makedirs(f"{base}/in")
    with open(f"{base}/in/a.json", "w") as f:
        f.write("\n".join(LINES) + "\n")
    R.start_headlines(spark, f"{base}/in", f"{base}/h", f"{base}/c", f"{base}/log", as_of="2024-02-01",
                      quarantine=quarantine).awaitTermination()
    assert [r["headline"] for r in R.open_table(spark, f"{base}/h", "headlines").collect()] == ["good"]
    aside = [(r["text"], r["batch_no"]) for r in R.read_quarantine(spark, f"{base}/h").collect()]
    assert sorted(aside) == (sorted((x, 0) for x in LINES[1:4]) if quarantine else [])
