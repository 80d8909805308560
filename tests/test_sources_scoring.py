"""Tables, landed feeds, pluggable scorer, properties from the survey."""

import datetime as dt
import json
import math
import os
import random
import tempfile
import zoneinfo

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tickerlens.functions.time import session_date_ts
from tickerlens.operators.scoring import score_in_pandas
from tickerlens.sources.feeds import explode_articles, read_articles
from tickerlens.sources.tables import ensure_tables, read_table


def test_ensure_tables_idempotent(spark):
    root = tempfile.mkdtemp(prefix="tables-")
    p1 = ensure_tables(spark, root)
    p2 = ensure_tables(spark, root)
    assert p1 == p2
    assert read_table(spark, root, "headlines").count() == 0
    assert "market_date" in read_table(spark, root, "prices").columns


def test_read_landed_feed(spark):
    d = tempfile.mkdtemp(prefix="feed-")
    docs = [{"ticker": "AAPL", "ticker_pos": 0, "batch_id": 1,
             "articles": [{"title": "A", "url": "https://www.x.com/a",
                           "publishedAt": "2026-05-14T13:42:00Z", "source": {"name": "X Y"}},
                          {"title": None}, {"source": None, "title": "B"}]},
            {"ticker": "SPY", "ticker_pos": 1, "batch_id": 1}]
    with open(os.path.join(d, "f.json"), "w") as f:
        for doc in docs:
            f.write(json.dumps(doc) + "\n")
    rows = explode_articles(read_articles(spark, d)).collect()
    assert len(rows) == 3            # missing articles array -> no rows
    assert rows[0].source_name == "X Y" and rows[2].source_name is None


class TinyScorer:
    """Bag-of-letters linear scorer: enough to exercise the Arrow path."""

    def load(self):
        self.w = np.array([[1.0, 0.0, -1.0]])

    def logits(self, texts):
        n = texts.str.len().to_numpy(dtype=float)[:, None]
        return n * self.w


def test_score_in_pandas(spark):
    df = spark.createDataFrame([("h1", "abc"), ("h2", "")], "headline_hash string, headline string")
    rows = {r.headline_hash: r for r in score_in_pandas(df, TinyScorer(), model_version="t").collect()}
    assert rows["h1"].sentiment_label == "negative"
    assert rows["h2"].sentiment_label == "negative" and math.isclose(rows["h2"].confidence, 1 / 3)


def _py_session(instant: dt.datetime) -> dt.date:
    """Independent day-by-day reference for F5."""
    local = instant.replace(tzinfo=dt.timezone.utc).astimezone(zoneinfo.ZoneInfo("America/New_York"))
    day = local.date() + (dt.timedelta(days=1) if local.hour >= 16 else dt.timedelta(0))
    while day.weekday() >= 5:
        day += dt.timedelta(days=1)
    return day


def test_session_date_property(spark):
    rnd = random.Random(11)
    start = dt.datetime(2015, 1, 1)
    inst = [start + dt.timedelta(seconds=rnd.randint(0, 12 * 365 * 86400)) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(inst)], "i int, ts timestamp_ntz")
    got = {r.i: r.d for r in df.select("i", session_date_ts("ts").alias("d")).collect()}
    for i, t in enumerate(inst):
        want = _py_session(t)
        assert got[i] == want, (t, got[i], want)
        assert got[i].weekday() < 5


def test_returns_telescope(spark):
    from __spark_entry__ import queries
    from tickerlens.plans import common as C
    r = C.returns(spark, SF_SMALL)
    agg = (r.groupBy("ticker")
           .agg(F.sum("daily_return").alias("s"),
                F.min_by("close", "market_date").alias("first"),
                F.max_by("close", "market_date").alias("last"),
                F.count_if(F.col("daily_return").isNull()).alias("nulls")))
    for row in agg.collect():
        assert row.nulls == 1      # only the first bar of each ticker
        assert math.isclose(row.s, math.log(row.last / row.first), rel_tol=1e-9, abs_tol=1e-9)
    assert queries()["rolling_pearson"](spark, SF_SMALL).filter(F.abs("pearson") > 1 + 1e-9).count() == 0


def test_ingest_idempotent_and_accounting(spark):
    from tickerlens.operators.ingest import ingest_headlines
    from tickerlens.plans import common as C
    rec = C.records(spark, SF_SMALL)
    stored = ingest_headlines(rec)
    assert ingest_headlines(rec, existing=stored).count() == 0
    acc = C.records(spark, SF_SMALL).count()
    from tickerlens.operators.ingest import accounting_by_batch
    tot = accounting_by_batch(rec).agg(F.sum("inserted").alias("i"), F.sum("skipped").alias("s")).first()
    assert tot.i + tot.s == acc and tot.i == stored.count()


def test_paging_rank_cells_match_one_window_with_null_times(spark):
    """The (minute, -bucket) cells give the same rank as one window per
    (ticker, batch), also when a third of the rows have no publish time."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tests.conftest import SF_MID
    from tickerlens.operators.rank import distributed_rank
    from tickerlens.sources import driver
    a = driver.article_rows(spark, SF_MID).withColumn(
        "published_at", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("published_at")))
    minute = F.substring(F.col("published_at"), 1, 16)
    bucket = F.when(F.col("published_at").isNull(), -F.floor(F.col("feed_rank") / F.lit(7)))
    order = [F.col("published_at").desc_nulls_last(), F.col("feed_rank")]
    r = distributed_rank(a, ["ticker", "batch_id"], F.struct(minute.alias("m"), bucket.alias("b")),
                         order, out="rk", cell_desc=True)
    w = Window.partitionBy("ticker", "batch_id").orderBy(*order)
    b = r.withColumn("rk2", F.row_number().over(w) - 1)
    assert b.count() == a.count() > 1000
    assert b.filter(F.col("rk") != F.col("rk2")).count() == 0


def test_keyword_of_a_long_headline_is_the_best_of_all_windows(spark):
    """The top token may stand in window 1 of the first line; ties go to the
    first window, other lines of the hash do not count, empty text has none."""
    from tickerlens.operators.scoring import decode_windows

    def row(h, doc, window, words, weights):
        toks = ["[CLS]", *words, "[SEP]"]
        att = [0.99, *weights, 0.98]
        return (doc, window, h, [0.1, 2.0, 0.3], toks, [att, att], len(toks))

    rows = [row("late", 5, 0, ["a", "b"], [0.2, 0.3]), row("late", 5, 1, ["c", "##top"], [0.1, 0.9]),
            row("late", 9, 0, ["other", "line"], [0.95, 0.96]),
            row("tie", 1, 1, ["second"], [0.4]), row("tie", 1, 0, ["x", "first"], [0.1, 0.4]),
            row("empty", 2, 0, [], [])]
    df = spark.createDataFrame(rows, "doc_id bigint, window int, headline_hash string, "
                               "logits array<double>, tokens array<string>, "
                               "attention array<array<double>>, length int")
    got = {r["headline_hash"]: (r["attention_keyword"], r["sentiment_label"])
           for r in decode_windows(df, "v").collect()}
    assert {h: k for h, (k, _) in got.items()} == {"late": "top", "tie": "first", "empty": None}
    assert {s for _, s in got.values()} == {"neutral"}
