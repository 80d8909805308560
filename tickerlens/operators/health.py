"""Health report.

Each table is aggregated in one pass to a single row (partial aggregation on
every mapper); the two one-row results are stacked and folded by a second
global aggregate over two rows, so there is no join of any kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def health_summary(headlines: DataFrame, prices: DataFrame,
                   headline_order=("batch_id", "ticker_pos", "feed_rank"),
                   price_order=("fetch_ord", "ticker", "market_date")) -> DataFrame:
    """A1/A2: total, scored (label NOT NULL), unscored, price rows, newest
    raw timestamp and newest price date by *arrival* (NULL stays NULL)."""
    h = headlines.agg(
        F.count(F.lit(1)).alias("total_headlines"),
        F.count("sentiment_label").alias("scored_headlines"),
        F.max_by(F.col("raw_timestamp"), F.struct(*headline_order)).alias("last_news_timestamp"))
    p = prices.agg(
        F.count(F.lit(1)).alias("total_price_records"),
        F.max_by(F.col("market_date"), F.struct(*price_order)).alias("last_price_date"))
    both = h.unionByName(p, allowMissingColumns=True)
    # exactly one of the two rows carries each column; max skips the NULL
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "total_headlines", "scored_headlines",
        (F.col("total_headlines") - F.col("scored_headlines")).alias("unscored_headlines"),
        "total_price_records", "last_news_timestamp", "last_price_date")


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that answers counts, minima and maxima
    of Parquet tables from the file footers (aggregate push-down of the second
    data source API); the caller's session keeps its settings."""
    s = spark.newSession()
    v1 = [x for x in s.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    s.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def footer_totals(session: SparkSession, path: str, schema: T.StructType, newest: str | None = None) -> DataFrame:
    """A1/A2 without a scan: rows of a stored table and, for a DATE or number
    column, its greatest value; no row is read."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if newest:
        aggs.append(F.max(newest).alias("newest"))
    out = session.read.schema(schema).parquet(path).agg(*aggs)
    # a table without files has no footer to add up: its count comes as NULL,
    # though the planner takes a count as never NULL
    return out.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(0))


def recent(df: DataFrame, n: int, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest ``n`` rows by arrival order (descending), ``cols`` only.

    Plans as TakeOrderedAndProject: each partition keeps its top ``n``."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).select(*cols)


def job_ledger(runs: DataFrame) -> DataFrame:
    """Ledger rows ``(job_name, ran_at, inserted, skipped, error)``
    with ``ran_at`` as ISO seconds + 'Z' (F14); a failed run logs (0, 0)."""
    from ..functions.time import iso_seconds_z
    failed = F.col("error").isNotNull()
    return runs.select(
        "run_id", "job_name", iso_seconds_z("ran_at_ts").alias("ran_at"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("inserted")).alias("inserted"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("skipped")).alias("skipped"),
        "error")


def health_card(summary: DataFrame) -> DataFrame:
    """the status-card text of ``health_summary`` (counts with
    thousands separators, newest values as text)."""
    from ..functions.text import thousands
    return summary.select(
        thousands("total_headlines").alias("total_headlines"),
        thousands("scored_headlines").alias("scored_headlines"),
        thousands("unscored_headlines").alias("unscored_headlines"),
        thousands("total_price_records").alias("total_price_records"),
        F.coalesce(F.col("last_news_timestamp"), F.lit("None")).alias("last_news_timestamp"),
        F.coalesce(F.col("last_price_date").cast("string"), F.lit("None")).alias("last_price_date"))
