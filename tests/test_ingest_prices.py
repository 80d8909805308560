"""Dedup ingest, price store and log returns (FIXTURES 2.4-2.6)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tickerlens.operators.ingest import first_arrivals, ingest_counts, ingest_headlines, with_hash
from tickerlens.operators.prices import ingest_prices, log_return

REC = ("ticker string, headline string, source string, raw_timestamp string, "
       "market_date date, batch_id bigint, ticker_pos int, feed_rank bigint")


def _batch(spark, rows, batch_id):
    data = [(t, h, "src", None, None, batch_id, i, i) for i, (t, h) in enumerate(rows)]
    return with_hash(spark.createDataFrame(data, REC))


def test_headline_dedup_golden(spark):
    b1 = _batch(spark, [("AAPL", "X"), ("SPY", "X "), ("AAPL", "x"), (None, "Y")], 1)
    new = ingest_headlines(b1)
    got = sorted((r.ticker, r.headline) for r in new.collect())
    assert got == [("AAPL", "X"), ("AAPL", "x")]
    c = ingest_counts(b1, new).first()
    assert (c.inserted, c.skipped) == (2, 2)
    # the same batch again against the stored table -> (0, 4)
    again = ingest_headlines(_batch(spark, [("AAPL", "X"), ("SPY", "X "), ("AAPL", "x"),
                                            (None, "Y")], 2), existing=new)
    c2 = ingest_counts(b1, again).first()
    assert (c2.inserted, c2.skipped) == (0, 4)
    empty = spark.createDataFrame([], REC)
    c3 = ingest_counts(empty, ingest_headlines(with_hash(empty))).first()
    assert (c3.inserted, c3.skipped) == (0, 0)


def test_per_ticker_keys_option(spark):
    b1 = _batch(spark, [("AAPL", "X"), ("SPY", "X")], 1)
    assert first_arrivals(b1, ("ticker", "headline_hash")).count() == 2


def test_log_return_golden(spark):
    d = [dt.date(2026, 5, i) for i in range(1, 9)]
    closes = [100.0, float("nan"), 110.0, 0.0, 120.0, -5.0, 130.0, 143.0]
    df = spark.createDataFrame([("T", d[i], closes[i]) for i in range(8)],
                               "ticker string, market_date date, close double")
    rows = log_return(df).orderBy("market_date").collect()
    assert len(rows) == 7
    r = {row.market_date: row.daily_return for row in rows}
    assert r[d[0]] is None
    assert math.isclose(r[d[2]], math.log(1.1))
    assert r[d[3]] is None and r[d[4]] is None and r[d[5]] is None and r[d[6]] is None
    assert math.isclose(r[d[7]], math.log(1.1))


def test_price_first_wins_golden(spark):
    d1, d2 = dt.date(2026, 5, 1), dt.date(2026, 5, 4)
    sch = "ticker string, market_date date, close double"
    f1 = log_return(spark.createDataFrame([("T", d1, 10.0)], sch)).withColumn("fetch_ord", F.lit(1))
    f2 = log_return(spark.createDataFrame([("T", d1, 11.0), ("T", d2, 12.0)], sch)) \
        .withColumn("fetch_ord", F.lit(2))
    new = ingest_prices(f2, existing=f1)
    stored = f1.unionByName(new)
    got = {r.market_date: (r.close, r.daily_return) for r in stored.collect()}
    assert got[d1] == (10.0, None)
    assert got[d2][0] == 12.0 and math.isclose(got[d2][1], math.log(12 / 11))
    assert new.count() == 1   # counts (1 inserted, 1 skipped)
    recomputed = {r.market_date: r.daily_return for r in log_return(stored.drop("daily_return")).collect()}
    assert math.isclose(recomputed[d2], math.log(12 / 10))
    last = ingest_prices(f1.unionByName(f2), policy="last_wins")
    assert {r.market_date: r.close for r in last.collect()}[d1] == 11.0


def test_unpivot_wide_and_flat(spark):
    from tickerlens.operators.prices import unpivot_prices
    d = dt.date(2026, 5, 1)
    wide = spark.createDataFrame([(d, 1.0, 2.0, 0.5, 1.5, 100.0, float("nan"), None, None, None, None)],
                                 "date date, A_Open double, A_High double, A_Low double, A_Close double, "
                                 "A_Volume double, B_Open double, B_High double, B_Low double, "
                                 "B_Close double, B_Volume double")
    rows = {r.ticker: r for r in unpivot_prices(wide, ["A", "B", "C"]).collect()}
    assert set(rows) == {"A", "B"}            # C absent -> skipped
    assert rows["A"].volume == 100 and rows["B"].open is None
    flat = spark.createDataFrame([(d, 1.0, 2.0, 0.5, 1.5, 3.9)],
                                 "date date, Open double, High double, Low double, Close double, Volume double")
    assert [r.ticker for r in unpivot_prices(flat, ["A"]).collect()] == ["A"]
    assert unpivot_prices(flat, ["A", "B"]).count() == 0
    assert unpivot_prices(flat, ["A"]).first().volume == 3


def test_stored_key_lookup_broadcasts_the_counted_batch(spark):
    """The history is probed map-side with the broadcast batch keys when the
    batch fits the threshold; without a count it is a shuffle join, and the
    rows are the same either way."""
    from tickerlens.operators.ingest import not_stored
    hist = spark.range(0, 5000).selectExpr("sha2(cast(id as string), 256) AS headline_hash")
    batch = spark.range(4990, 5010).selectExpr("sha2(cast(id as string), 256) AS headline_hash",
                                               "id")
    small = not_stored(batch, hist, ["headline_hash"])
    plain = not_stored(batch, hist, ["headline_hash"])
    p = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    assert sorted(r.id for r in small.collect()) == list(range(5000, 5010))
    assert sorted(r.id for r in plain.collect()) == list(range(5000, 5010))
