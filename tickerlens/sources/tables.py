"""Stored tables (S8): fixed schemas and create-if-absent.

The three tables of the original store become Parquet datasets under one
root: ``headlines`` (first-wins by hash), ``scores`` (append-only, latest
wins per hash), ``prices`` (first-wins by ticker and date, partitioned by
``market_date`` so date windows prune) and ``job_log`` (append-only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HEADLINES = T.StructType([
    T.StructField("headline_hash", T.StringType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("headline", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("raw_timestamp", T.StringType()),
    T.StructField("market_date", T.DateType()),
    T.StructField("published_ts", T.TimestampNTZType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("ticker_pos", T.IntegerType()),
    T.StructField("feed_rank", T.LongType()),
])

SCORES = T.StructType([
    T.StructField("headline_hash", T.StringType(), False),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("attention_keyword", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("score_seq", T.LongType()),
])

PRICES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("daily_return", T.DoubleType()),
    T.StructField("fetch_ord", T.LongType()),
    T.StructField("market_date", T.DateType(), False),
])

JOB_LOG = T.StructType([
    T.StructField("job_name", T.StringType(), False),
    T.StructField("ran_at", T.StringType(), False),
    T.StructField("inserted", T.LongType(), False),
    T.StructField("skipped", T.LongType(), False),
    T.StructField("error", T.StringType()),
])

TABLES = {"headlines": (HEADLINES, None), "scores": (SCORES, None),
          "prices": (PRICES, "market_date"), "job_log": (JOB_LOG, None)}


# the streams commit every micro-batch under these partition columns
COMMIT = [T.StructField("run", T.StringType()), T.StructField("batch_no", T.LongType())]


def stream_schema(name: str) -> T.StructType:
    """The stored schema of a table that a stream writes."""
    return T.StructType([*TABLES[name][0].fields, *COMMIT])


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType,
                     partition_by: tuple[str, ...] = ()) -> None:
    """An empty dataset at ``path`` unless there is one (idempotent)."""
    w = spark.createDataFrame([], schema).write.mode("ignore")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def ensure_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create every absent table as an empty dataset with its fixed schema;
    existing tables are left untouched (idempotent).  Returns name -> path."""
    paths = {}
    for name, (schema, part) in TABLES.items():
        path = f"{root.rstrip('/')}/{name}"
        paths[name] = path
        create_if_absent(spark, path, schema, (part,) if part else ())
    return paths


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema, _ = TABLES[name]
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
