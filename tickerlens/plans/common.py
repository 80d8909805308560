"""Shared pieces of the registered query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import first_arrivals, headline_records
from ..operators.prices import log_return, ohlcv_bars
from ..sources import driver

# --- fixed values (query parameters, our choice) ----------------------------
AS_OF = "2024-02-01"          # run date used when a timestamp cannot be parsed
PRICE_AS_OF = "2024-01-25"    # "today" of the price-window query
SPLIT_CUT = "2024-01-16 18:00:00"   # UTC instant splitting two ingest runs
TICKERS = [f"T{i:02d}" for i in range(driver.N_TICKERS)]
ROLL_WINDOW = 3               # sessions in the rolling correlation
# ---------------------------------------------------------------------------


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (report precision for comparisons)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv_bars(driver.ticks(spark, sf_dir))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_return(bars(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ingest import with_hash
    return with_hash(headline_records(driver.article_rows(spark, sf_dir), as_of=AS_OF),
                     stripped=True)


def stored_headlines(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] | None = None) -> DataFrame:
    return first_arrivals(records(spark, sf_dir), carry=carry)


# --- more fixed query parameters (our choice) -------------------------------
FEED_AS_OF = "2024-01-20"     # run date of the feed-window query
PRICE_CUT = "2024-01-16 18:00:00"   # first price fetch sees ticks before this
# Ticker -> search query; tickers without an entry search for themselves.
TOPIC_QUERIES = {
    "T00": "the market",
    "T01": "der die und",
    "T02": "de la que",
    "T03": "that was",
    "T04": "orre rewh",
}
SPIKE_LOOKBACK = 5
SPIKE_MIN_HISTORY = 2
SPIKE_K = 1.0
HORIZONS = (1, 4, 24)
ASOF_CELL_SECONDS = 3600      # as-of join time cell (hot tickers span many)
BACKLOG_LIMIT = 200
DAMAGED_EVERY = 5             # feed responses that the quarantine queries cut short
# ---------------------------------------------------------------------------


def cut_slot() -> int:
    """Poll slot of ``SPLIT_CUT`` (two ingest runs split on a slot edge)."""
    import datetime as dt
    t = dt.datetime.fromisoformat(SPLIT_CUT)
    days = (t.date() - dt.date(1970, 1, 1)).days
    return days * (24 // driver.POLL_HOURS) + t.hour // driver.POLL_HOURS


def topics(spark: SparkSession) -> DataFrame:
    from ..sources.feeds import topic_table
    return topic_table(spark, TICKERS, TOPIC_QUERIES)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.human_scores(spark, sf_dir)


def scored_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import with_latest_scores
    return with_latest_scores(stored_headlines(spark, sf_dir), scores(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.analytics import daily_sentiment
    return daily_sentiment(scored_headlines(spark, sf_dir))


def stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two price fetches, first wins per (ticker, date): the first fetch sees
    ticks before ``PRICE_CUT`` only (a mid-session close stays frozen)."""
    from ..operators.prices import ingest_prices
    t = driver.ticks(spark, sf_dir)
    f1 = log_return(ohlcv_bars(t.filter(F.col("ts") < F.lit(PRICE_CUT).cast("timestamp_ntz"))))
    f2 = log_return(ohlcv_bars(t))
    f1 = f1.withColumn("fetch_ord", F.lit(1))
    f2 = f2.withColumn("fetch_ord", F.lit(2))
    return f1.unionByName(ingest_prices(f2, existing=f1))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.corpus import parse_corpus
    return parse_corpus(driver.corpus_lines(spark, sf_dir))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.corpus import stratified_split
    return stratified_split(corpus(spark, sf_dir), seed=42)


# Stop words of the keyword query (a query parameter, our choice).
STOP_WORDS = (
    "a about after again all also an and any are as at be been before but by can could did do "
    "does for from had has have he her his how i if in into is it its may more most no not of on "
    "or our out over she should so some such than that the their them then there these they this "
    "to under up was we were what when where which while who will with would you your"
).split()
