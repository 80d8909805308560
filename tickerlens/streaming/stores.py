"""Stored tables of the streams, laid out so that a micro-batch looks up what
it may collide with and nothing else.

* ``headlines`` has a slim key table beside it, partitioned by the first hex
  digits of the hash (``prefix``).  A micro-batch knows its prefixes from the
  pass that stages it, so the look-up reads those prefixes' keys only.
* ``prices`` is partitioned by ``market_date``; a micro-batch reads the dates it
  holds, and a date window reads its own dates.

Below that every table is partitioned by ``run`` and ``batch_no``: a replayed
micro-batch overwrites its own partitions, so no MERGE is needed.

A micro-batch is staged first: one pass parses the source, writes the rows (of
headlines the keys only; their texts are read from the landed files once more
when they are stored) and observes their counters (rows, late rows, prefixes or
dates) in the tasks that write.  Look-ups read the staged rows, with their real
size known to the planner.  The staging folder belongs to one query and holds
one micro-batch.

Headline hashes are moved as their 32 bytes and stored as hex text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import hex_hash, packed_hash
from ..sources.tables import COMMIT, create_if_absent, stream_schema

COMMIT_COLS = ("run", "batch_no")
PREFIX_DIGITS = 1             # hex digits of a key partition: 16, 256, 4096, ... partitions
CODEC = "zstd"                # of stored and staged rows (mostly text)
TABLE_PARTITIONS = {"headlines": COMMIT_COLS, "scores": COMMIT_COLS,
                    "prices": ("market_date", *COMMIT_COLS)}


@dataclass(frozen=True)
class Counts:
    """What one micro-batch did; ``newest`` is the latest publish time seen."""
    inserted: int = 0
    skipped: int = 0
    late: int = 0
    newest: dt.datetime | None = None


def prefix_of(key: Column | str, digits: int = PREFIX_DIGITS) -> Column:
    return F.substring(key, 1, digits)


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stream's table, created if absent, read with its fixed schema (an
    unreadable table is an error, not an empty one)."""
    schema = stream_schema(name)
    create_if_absent(spark, path, schema, TABLE_PARTITIONS[name])
    return spark.read.schema(schema).parquet(path)


def others(table: DataFrame, run: str, batch_no: int) -> DataFrame:
    """Rows that other micro-batches wrote."""
    return table.filter((F.col("run") != run) | (F.col("batch_no") != batch_no))


def own(table: DataFrame, run: str, batch_no: int) -> DataFrame:
    return table.filter((F.col("run") == run) & (F.col("batch_no") == batch_no))


def _overwrite(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
     .partitionBy(*partitions).parquet(path))


def staged(df: DataFrame, path: str, **counters: Column) -> tuple[DataFrame, dict]:
    """Write one micro-batch's rows, read them back, and what was observed on
    the way.  The rows go from the source to the files without a shuffle, so
    the counters come from result tasks, each counted once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"),
               *[c.alias(k) for k, c in counters.items()]).write.mode("overwrite").option(
                   "compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def commit(df: DataFrame, path: str, name: str, run: str, batch_no: int) -> int:
    """Write one micro-batch to its own partitions; the rows written, observed
    in the tasks that write them."""
    rows = df.withColumns({"run": F.lit(run), "batch_no": F.lit(batch_no).cast("bigint")})
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stream_schema(name).fields]
    seen = Observation()
    _overwrite(rows.select(*cols).observe(seen, F.count(F.lit(1)).alias("n")), path,
               TABLE_PARTITIONS[name])
    return seen.get["n"]


# ------------------------------------------------------------------- keys ----

def keys_path(table_path: str, digits: int = PREFIX_DIGITS) -> str:
    """One key table per number of digits: a store that grows can change to
    more digits, its keys are then dealt anew from the table."""
    return f"{table_path.rstrip('/')}_keys{digits}"


def _key_schema(keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(k, T.StringType()) for k in keys],
                         T.StructField("prefix", T.StringType()), *COMMIT])


def _key_rows(table: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    return table.select(*keys, prefix_of(keys[-1], digits).alias("prefix"), *COMMIT_COLS)


def open_keys(spark: SparkSession, table_path: str, keys: Sequence[str],
              digits: int = PREFIX_DIGITS) -> DataFrame:
    """The key table beside ``headlines``; made from the table where only the
    table exists (one written without keys)."""
    path = keys_path(table_path, digits)
    schema = _key_schema(keys)
    create_if_absent(spark, path, schema, ("prefix", *COMMIT_COLS))
    found = spark.read.schema(schema).parquet(path)
    if not found.take(1):
        table = open_table(spark, table_path, "headlines")
        if table.take(1):
            _overwrite(_key_rows(table, keys, digits).repartition("prefix"), path, ("prefix", *COMMIT_COLS))
            found = spark.read.schema(schema).parquet(path)
    return found


def commit_keys(spark: SparkSession, table_path: str, keys: Sequence[str], run: str, batch_no: int,
                digits: int = PREFIX_DIGITS) -> None:
    """Write the keys of a committed micro-batch.  A crash before this step
    leaves the batch uncommitted for the stream, and its replay writes both."""
    rows = _key_rows(own(open_table(spark, table_path, "headlines"), run, batch_no), keys, digits)
    _overwrite(_dealt(rows, "prefix", run, batch_no), keys_path(table_path, digits), ("prefix", *COMMIT_COLS))


def _dealt(rows: DataFrame, by: str, run: str, batch_no: int) -> DataFrame:
    """Key rows of one commit, brought together ``by`` a column."""
    rows = hex_hash(packed_hash(rows.drop(*COMMIT_COLS)).repartition(by))
    return rows.withColumns({"run": F.lit(run), "batch_no": F.lit(batch_no).cast("bigint")})


def stored_keys(spark: SparkSession, table_path: str, keys: Sequence[str], prefixes: Sequence[str],
                run: str, batch_no: int, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Keys that other micro-batches stored under ``prefixes`` (partition
    filters on both, so no other partition is read)."""
    found = others(open_keys(spark, table_path, keys, digits), run, batch_no)
    return found.filter(F.col("prefix").isin(list(prefixes)))


def unseen(winners: DataFrame, batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``winners`` whose key is not stored.  The stored keys that
    the batch holds are found first (reading only the batch's key columns),
    then the winners are anti-joined against those few.  ``winners`` and
    ``batch`` have packed hashes."""
    on = list(keys)
    if stored.isEmpty():              # a first run: nothing to look up
        return winners
    hits = packed_hash(stored.select(*on)).join(batch.select(*on), on, "left_semi")
    return winners.join(hits, on, "left_anti")


# -------------------------------------------------- keys by session (R2) ----

def day_keys_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_days"


def open_day_keys(spark: SparkSession, table_path: str, keys: Sequence[str]) -> DataFrame:
    """Keys by the session they arrived for."""
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys],
                           T.StructField("market_date", T.DateType()), *COMMIT])
    create_if_absent(spark, day_keys_path(table_path), schema, ("market_date", *COMMIT_COLS))
    return spark.read.schema(schema).parquet(day_keys_path(table_path))


def recent_keys(spark: SparkSession, table_path: str, keys: Sequence[str], since: dt.date | None,
                run: str, batch_no: int) -> DataFrame:
    """Keys that other micro-batches stored for sessions from ``since`` on (a
    partition filter: older sessions are not read)."""
    found = others(open_day_keys(spark, table_path, keys), run, batch_no)
    return found.filter(F.col("market_date") >= F.lit(since).cast("date"))


def commit_day_keys(spark: SparkSession, table_path: str, keys: Sequence[str], run: str, batch_no: int) -> None:
    rows = own(open_table(spark, table_path, "headlines"), run, batch_no).select(*keys, "market_date")
    _overwrite(_dealt(rows, "market_date", run, batch_no),
               day_keys_path(table_path), ("market_date", *COMMIT_COLS))


def newest_rows(spark: SparkSession, table_path: str, name: str, ledger: DataFrame, k: int,
                order: Sequence[str]) -> DataFrame:
    """The ``k`` newest rows of a stream's table, by the ledger: from the
    newest commits that together hold ``k`` rows, and no other files.  ``ledger``
    has one small row per commit; at most ``k`` commits are taken."""
    commits = (ledger.filter(F.col("error").isNull() & (F.col("inserted") > 0))
               .orderBy(F.col("ran_at").desc(), F.col("batch_no").desc()).limit(k)
               .select("run", "batch_no", "inserted").collect())
    wanted, have = F.lit(False), 0
    for c in commits:
        if have >= k:
            break
        wanted, have = wanted | ((F.col("run") == c["run"]) & (F.col("batch_no") == c["batch_no"])), have + c["inserted"]
    rows = open_table(spark, table_path, name).filter(wanted)
    return rows.orderBy(F.col("batch_no").desc(), *[F.col(c).desc() for c in order]).limit(k)


# ----------------------------------------------------------------- prices ----

def stored_prices(spark: SparkSession, path: str, dates: Sequence[dt.date]) -> DataFrame:
    """Stored bars of ``dates`` (a partition filter)."""
    return open_table(spark, path, "prices").filter(F.col("market_date").isin(list(dates)))


def write_prices(bars: DataFrame, path: str, run: str = "load", batch_no: int = 0) -> DataFrame:
    """Store bars by date and read the store back; a repeated load replaces
    itself.  One shuffle by date, so a date is written by one task."""
    spark = bars.sparkSession
    open_table(spark, path, "prices")
    if "fetch_ord" not in bars.columns:
        bars = bars.withColumn("fetch_ord", F.lit(0).cast("bigint"))
    commit(bars.repartition("market_date"), path, "prices", run, batch_no)
    return open_table(spark, path, "prices")
