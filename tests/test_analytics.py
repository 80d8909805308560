"""Rolling Pearson, as-of join vs brute force, health (FIXTURES 2.12, 2.14)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickerlens.operators.analytics import rolling_pearson
from tickerlens.operators.asof import asof_forward
from tickerlens.operators.health import health_summary


def test_rolling_pearson_golden(spark):
    d = [dt.date(2026, 5, i) for i in range(1, 6)]
    rows = [("A", d[0], 1.0, 2.0), ("A", d[1], 2.0, 4.0), ("A", d[2], 3.0, 6.0),
            ("B", d[0], 1.0, 2.0), ("B", d[1], 1.0, 3.0), ("B", d[2], 1.0, 5.0),
            ("C", d[0], 1.0, None), ("C", d[1], 2.0, 1.0), ("C", d[2], 3.0, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, market_date date, mean_sentiment double, "
                                     "next_return double")
    got = {(r.ticker, r.market_date): r.pearson for r in rolling_pearson(df, 3).collect()}
    assert got[("A", d[0])] is None and got[("A", d[1])] is None
    assert abs(got[("A", d[2])] - 1.0) < 1e-12
    assert got[("B", d[2])] is None          # constant side
    assert got[("C", d[2])] is None          # only 2 complete pairs


def test_asof_forward_matches_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    ticks = [(f"K{rnd.randint(0, 2)}", base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 9)),
              i, float(i)) for i in range(600)]
    probes = [(f"K{rnd.randint(0, 3)}", base + dt.timedelta(minutes=rnd.randint(-60, 60 * 24 * 10)),
               j) for j in range(200)]
    tdf = spark.createDataFrame(ticks, "k string, ts timestamp_ntz, tick_id long, price double")
    pdf = spark.createDataFrame(probes, "k string, pt timestamp_ntz, probe_id long")
    got = {r.probe_id: r.match_id for r in
           asof_forward(pdf, tdf, "k", "pt", "ts", "tick_id", "price", cell_seconds=3600).collect()}
    for k, pt, pid in probes:
        cands = [(t, i) for kk, t, i, _ in ticks if kk == k and t >= pt]
        want = min(cands)[1] if cands else None
        assert got[pid] == want, (pid, got[pid], want)


def test_health_golden(spark):
    h = spark.createDataFrame(
        [("t3", 1, 0, 0, "positive"), ("t1", 1, 0, 1, None), (None, 1, 0, 2, None)],
        "raw_timestamp string, batch_id long, ticker_pos int, feed_rank long, sentiment_label string")
    p = spark.createDataFrame([], "market_date date, fetch_ord int, ticker string")
    r = health_summary(h, p).first()
    assert (r.total_headlines, r.scored_headlines, r.unscored_headlines) == (3, 1, 2)
    assert r.last_news_timestamp is None
    assert r.total_price_records == 0 and r.last_price_date is None
    e = health_summary(h.limit(0), p).first()
    assert e.total_headlines == 0 and e.last_news_timestamp is None
