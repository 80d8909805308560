"""Price operators: bars (X6), log returns (W1, P5, L4), window (S5),
wide/long reshape (U2) and first-wins price ingest (S10).

Scale notes
-----------
* ``ohlcv_bars`` is a hash aggregate with map-side partial aggregation
  (``min_by``/``max_by``/``max``/``min``/``count`` are all partial-capable),
  so a ticker holding a third of all ticks is combined on every mapper before
  the shuffle; one row per (ticker, session) crosses the network.
* ``log_return`` windows over bars, never over ticks: a ticker's bar history
  is one row per session, small even for the hottest ticker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import guarded_log_ratio, safe_bigint, safe_double
from ..functions.time import days_from, session_date_ts

BAR_COLUMNS = ["ticker", "market_date", "open", "high", "low", "close", "volume"]


def ohlcv_bars(ticks: DataFrame, ticker: str = "ticker", ts: str = "ts",
               price: str = "price", tick_id: str = "tick_id") -> DataFrame:
    """Daily OHLCV bars per (ticker, trading session of the tick).

    open/close are the first/last price by (ts, tick_id); volume counts ticks.
    """
    order = F.struct(F.col(ts), F.col(tick_id))
    return (ticks
            .withColumn("market_date", session_date_ts(F.col(ts)))
            .groupBy(F.col(ticker).alias("ticker"), "market_date")
            .agg(F.min_by(F.col(price), order).alias("open"),
                 F.max(price).alias("high"),
                 F.min(price).alias("low"),
                 F.max_by(F.col(price), order).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def log_return(bars: DataFrame, key: str | Sequence[str] = "ticker",
               order: str = "market_date", value: str = "close",
               out: str = "daily_return") -> DataFrame:
    """Drop NULL/NaN closes (P5), then ``ln(close / previous close)`` in
    ascending date order per key (L4); NULL for the first row and whenever
    the previous close or the ratio is not positive (F6)."""
    keys = [key] if isinstance(key, str) else list(key)
    v = F.col(value)
    valid = bars.filter(v.isNotNull() & ~F.isnan(v))
    w = Window.partitionBy(*keys).orderBy(order)
    return valid.withColumn(out, guarded_log_ratio(v, F.lag(v).over(w)))


def price_window(bars: DataFrame, as_of, days: int = 14,
                 order: str = "market_date") -> DataFrame:
    """Bars in the half-open window ``[as_of - days, as_of + 1)``.

    On a table partitioned by ``market_date`` this prunes partitions."""
    d = F.col(order)
    return bars.filter((d >= days_from(as_of, -days)) & (d < days_from(as_of, 1)))


def pivot_prices(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Wide frame (date, then Open/High/Low/Close/Volume per ticker), the
    shape a multi-ticker download delivers.  ``tickers`` is the configured
    list, so the pivot values are fixed and no extra pass discovers them."""
    fields = {"Open": "open", "High": "high", "Low": "low", "Close": "close",
              "Volume": "volume"}
    aggs = [F.first(F.col(src)).alias(dst) for dst, src in fields.items()]
    wide = (bars.groupBy(F.col("market_date").alias("date"))
            .pivot("ticker", list(tickers)).agg(*aggs))
    # pivot names columns "<ticker>_<Field>"
    return wide


def unpivot_prices(wide: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Wide (field, ticker) columns -> one row per (ticker, date).

    Tickers whose columns are absent are skipped; numeric guards F7/F8 are
    applied; rows whose close is NULL/NaN are dropped later by ``log_return``.
    """
    if not any(f"{t}_Close" in wide.columns for t in tickers) and "Close" in wide.columns:
        # Q20: a flat frame (no ticker level) belongs to the only configured
        # ticker; with several tickers it cannot be attributed -> no rows
        if len(tickers) == 1:
            flat = ["Open", "High", "Low", "Close", "Volume"]
            wide = wide.select("date", *[
                (F.col(c) if c in wide.columns else F.lit(None).cast("double"))
                .alias(f"{tickers[0]}_{c}") for c in flat])
        else:
            tickers = []
    present = [t for t in tickers if f"{t}_Close" in wide.columns]
    if not present:
        return wide.sparkSession.createDataFrame(
            [], "ticker string, market_date date, open double, high double, "
                "low double, close double, volume bigint")

    def col_or_null(name: str):
        return F.col(f"`{name}`") if name in wide.columns else F.lit(None).cast("double")

    rows = F.array(*[F.struct(F.lit(t).alias("ticker"),
                              col_or_null(f"{t}_Open").cast("double").alias("open"),
                              col_or_null(f"{t}_High").cast("double").alias("high"),
                              col_or_null(f"{t}_Low").cast("double").alias("low"),
                              col_or_null(f"{t}_Close").cast("double").alias("close"),
                              col_or_null(f"{t}_Volume").cast("double").alias("volume"))
                     for t in present])
    long = wide.select(F.col("date").alias("market_date"), F.inline(rows))
    return long.select(
        "ticker", "market_date",
        safe_double("open").alias("open"), safe_double("high").alias("high"),
        safe_double("low").alias("low"),
        F.col("close"),
        safe_bigint("volume").alias("volume"))


def ingest_prices(batch: DataFrame, existing: DataFrame | None = None,
                  policy: str = "first_wins",
                  order: str = "fetch_ord") -> DataFrame:
    """New stored rows for a fetched batch.

    Unique key (ticker, market_date).  ``first_wins`` keeps the earliest
    arrival (``order`` column) and never touches stored rows (parity);
    ``last_wins`` keeps the latest arrival and lets it replace a stored row.
    Rows with a NULL key are rejected.
    """
    if policy not in ("first_wins", "last_wins"):
        raise ValueError(f"unknown policy {policy!r}")
    keys = ["ticker", "market_date"]
    valid = batch.filter(F.col("ticker").isNotNull() & F.col("market_date").isNotNull())
    payload = [c for c in valid.columns if c not in keys]
    pick = F.min_by if policy == "first_wins" else F.max_by
    winners = (valid.groupBy(*keys)
               .agg(pick(F.struct(*payload), F.col(order)).alias("r"))
               .select(*keys, "r.*"))
    if existing is not None and policy == "first_wins":
        from .ingest import not_stored
        winners = not_stored(winners, existing, keys)
    return winners


def latest_prices(stored: DataFrame, order: str = "fetch_ord") -> DataFrame:
    """The latest-wins view of an append-only price store: one row per
    (ticker, market_date), that of the last fetch."""
    keys = ["ticker", "market_date"]
    payload = [c for c in stored.columns if c not in keys]
    return (stored.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("r"))
            .select(*keys, "r.*"))
