"""Sentiment x price analytics, declared as roadmap by the reference
(X1 daily sentiment, J4 join, X2 rolling Pearson, X3 event study).

Headlines are aggregated to (ticker, market_date) *before* joining prices,
so fan-out can never double count a return.  Every window is over
per-session rows (one per ticker and day), never over raw headlines/ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import guarded_log_ratio
from ..functions.text import polarity
from .asof import asof_forward


def daily_sentiment(scored: DataFrame, first_published: str | None = None) -> DataFrame:
    """Per (ticker, market_date): unweighted mean polarity (-1/0/+1),
    confidence-weighted mean and scored-headline count.  Unscored rows do
    not count; days without any scored headline are dropped.

    With ``first_published`` the same single aggregation also returns
    ``t0``, the earliest publication of the day over all stored headlines."""
    lab = F.col("sentiment_label")
    p = polarity(lab)
    conf = F.when(lab.isNotNull(), F.col("confidence"))
    aggs = [F.avg(p).alias("mean_sentiment"),
            F.try_divide(F.sum(p * conf), F.sum(conf)).alias("weighted_sentiment"),
            F.count(lab).alias("n_headlines")]
    if first_published:
        aggs.append(F.min(first_published).alias("t0"))
    return (scored.groupBy("ticker", "market_date").agg(*aggs)
            .filter(F.col("n_headlines") > 0))


def with_next_return(returns: DataFrame) -> DataFrame:
    """Next stored session's log return per ticker (over *all* bars, so it
    does not depend on which days have headlines)."""
    w = Window.partitionBy("ticker").orderBy("market_date")
    return returns.withColumn("next_return", F.lead("daily_return").over(w))


def sentiment_price_join(daily: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily sentiment joined to the session's bar on (ticker, date)."""
    r = with_next_return(returns).select(
        "ticker", "market_date", "close", "daily_return", "next_return")
    return daily.join(r, ["ticker", "market_date"])


def rolling_pearson(joined: DataFrame, window: int, x: str = "mean_sentiment",
                    y: str = "next_return") -> DataFrame:
    """Pearson correlation of x and y over the last ``window`` rows per
    ticker (ordered by date).  Only complete pairs count; NULL until
    ``window`` complete pairs exist and when either side is constant.

    Written as covar_pop / (stddev_pop * stddev_pop) with ``try_divide`` on
    masked pairs: ``corr`` raises under ANSI on a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xm, ym = F.when(both, F.col(x)), F.when(both, F.col(y))
    w = (Window.partitionBy("ticker").orderBy("market_date")
         .rowsBetween(-(window - 1), Window.currentRow))
    n = F.count(xm).over(w)
    denom = F.stddev_pop(xm).over(w) * F.stddev_pop(ym).over(w)
    r = F.try_divide(F.covar_pop(xm, ym).over(w), F.when(denom > 0, denom))
    return joined.select("ticker", "market_date", x, y, n.alias("n_pairs"),
                         F.when(n >= window, r).alias("pearson"))


def sentiment_spikes(daily: DataFrame, lookback: int = 5, min_history: int = 2,
                     k: float = 1.0) -> DataFrame:
    """Spike days: |z| >= k where z compares a day's mean sentiment with the
    previous ``lookback`` sessions of that ticker (sample stddev).  ``daily``
    carries ``t0``, the event time of the spike (see ``daily_sentiment``)."""
    w = (Window.partitionBy("ticker").orderBy("market_date")
         .rowsBetween(-lookback, -1))
    m = F.avg("mean_sentiment").over(w)
    sd = F.stddev_samp("mean_sentiment").over(w)
    n = F.count("mean_sentiment").over(w)
    z = F.try_divide(F.col("mean_sentiment") - m, F.when(sd > 0, sd))
    return (daily.select("ticker", "market_date", "mean_sentiment", "t0",
                         n.alias("n_hist"), z.alias("z"))
            .filter((F.col("n_hist") >= min_history) & (F.abs(F.col("z")) >= k)
                    & F.col("t0").isNotNull()))


def event_study(spikes: DataFrame, ticks: DataFrame,
                horizons_hours: Sequence[int] = (1, 4, 24),
                cell_seconds: int = 86400) -> DataFrame:
    """Log return from the first tick at/after the spike time ``t0`` to
    the first tick at/after ``t0 + h`` for each horizon, summarised per
    (horizon, direction): n, mean, sample stddev, min, max."""
    hs = [0] + [int(h) for h in horizons_hours]
    probes = (spikes.select("ticker", "market_date", "t0",
                            F.signum("z").cast("int").alias("direction"),
                            F.explode(F.array(*[F.lit(h) for h in hs])).alias("horizon_hours"))
              .withColumn("pt", F.timestamp_add("HOUR", F.col("horizon_hours"), F.col("t0"))))
    hit = asof_forward(probes, ticks, "ticker", "pt", "ts", "tick_id", "price",
                       cell_seconds=cell_seconds)
    # base price = the horizon-0 probe of the same spike (4 rows per window)
    w = Window.partitionBy("ticker", "market_date").orderBy("horizon_hours")
    ret = (hit.withColumn("p0", F.first("match_value").over(w))
           .filter(F.col("horizon_hours") > 0)
           .withColumn("ret", guarded_log_ratio(F.col("match_value"), F.col("p0"))))
    return (ret.groupBy("horizon_hours", "direction")
            .agg(F.count("ret").alias("n_events"),
                 F.avg("ret").alias("mean_return"),
                 F.stddev_samp("ret").alias("std_return"),
                 F.min("ret").alias("min_return"),
                 F.max("ret").alias("max_return")))
