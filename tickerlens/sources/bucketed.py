"""Tables bucketed by a join key: the stored form of an index.

Both sides of a frequent join are written once, hashed by the key into the same
number of buckets and sorted inside each.  A join on the key then reads bucket
against bucket: neither side is shuffled again, however often it is run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import with_next_return

SESSION_KEY = ("ticker", "market_date")
BUCKETS = 32                  # per table; a join of two tables needs equal numbers


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str] = SESSION_KEY,
                   buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` at ``path`` as table ``name``, bucketed and sorted by
    ``keys``, and read it back.  The rows are dealt by the same hash first, so
    every bucket is one file; a table of that name is replaced."""
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    (dealt.write.format("parquet").mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None where there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def index_sessions(daily: DataFrame, returns: DataFrame, name: str, path: str,
                   buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Daily sentiment and session bars, both bucketed by (ticker,
    market_date).  The next session's return needs all bars of a ticker, so it
    is worked out before the bars are stored."""
    bars = with_next_return(returns).select("ticker", "market_date", "close", "daily_return", "next_return")
    return (write_bucketed(daily, f"{name}_daily", f"{path}/daily", buckets=buckets),
            write_bucketed(bars, f"{name}_bars", f"{path}/bars", buckets=buckets))


def indexed_join(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Daily sentiment with its session's bar, bucket against bucket."""
    return daily.join(bars.hint("merge"), list(SESSION_KEY))
