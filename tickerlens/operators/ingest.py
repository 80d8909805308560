"""Headline ingest: title clean (P1), dedup with first-wins (S9, W2, J1) and
inserted/skipped accounting (A6).

Arrival order is the struct ``(batch_id, ticker_pos, feed_rank)``; it
replaces an autoincrement id and is unique per record.  One row per key is
chosen with ``min_by`` so the aggregate is partial on the map side: a story
repeated a million times is reduced on every mapper before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title, headline_hash, source_of, title_kept_raw
from ..functions.time import as_of_date, parse_iso_utc, session_date_ts

ORDER_COLS = ["batch_id", "ticker_pos", "feed_rank"]
STORED_COLS = ["ticker", "headline", "source", "raw_timestamp", "market_date",
               "headline_hash"]
NOT_NULL = ["ticker", "headline", "source", "headline_hash"]


def headline_records(articles: DataFrame, as_of=None,
                     strip_mode: str = "charset") -> DataFrame:
    """Feed articles -> headline records.

    Input columns: ticker, title, source_name, url, published_at, batch_id,
    ticker_pos, feed_rank.  Removed/empty titles are dropped here and are
    *not* counted as skipped later.
    """
    t = clean_title("title")
    # parse once; the session date is derived from the parsed instant (a
    # projection referenced twice is not collapsed, so the parse runs once)
    # the keep test reads the raw title (no strip inside the filter, which
    # the optimizer would otherwise evaluate a second time below the project)
    kept = articles.filter(title_kept_raw("title")).withColumn("headline", t)
    timed = with_times(kept.withColumn("raw_timestamp", F.col("published_at")), as_of)
    return timed.select(
        "ticker", "headline",
        source_of("source_name", "url", strip_mode).alias("source"),
        "raw_timestamp", "market_date", "published_ts", *ORDER_COLS)


def with_times(records: DataFrame, as_of=None) -> DataFrame:
    """publish time and session of ``raw_timestamp``."""
    return (records.withColumn("published_ts", parse_iso_utc("raw_timestamp"))
            .withColumn("market_date", F.coalesce(session_date_ts("published_ts"), as_of_date(as_of))))


def with_hash(records: DataFrame, stripped: bool = False) -> DataFrame:
    """F1 on ``headline``; ``stripped=True`` skips the strip for headlines
    that ``headline_records`` already cleaned (same hash, one regex less)."""
    h = F.sha2(F.col("headline"), 256) if stripped else headline_hash("headline")
    return records.withColumn("headline_hash", h)


def packed_hash(df: DataFrame) -> DataFrame:
    """The hash as its 32 bytes: half of what its hex text takes in a shuffle."""
    return df.withColumn("headline_hash", F.unhex("headline_hash"))


def hex_hash(df: DataFrame) -> DataFrame:
    """``packed_hash`` undone."""
    return df.withColumn("headline_hash", F.lower(F.hex("headline_hash")))


def first_arrivals(records: DataFrame, keys: Sequence[str] = ("headline_hash",),
                   carry: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the earliest by arrival order.  Rows violating
    NOT NULL are rejected first so they can never win a key.  ``carry`` names the
    other columns that are wanted (all of them by default): the planner does not
    prune what a winner carries."""
    keys = list(keys)
    if "headline_hash" not in records.columns:
        records = with_hash(records)
    valid = records.filter(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in NOT_NULL)))
    payload = [c for c in valid.columns if c not in keys and (carry is None or c in carry)]
    return (valid.groupBy(*keys)
            .agg(F.min_by(F.struct(*payload), F.struct(*ORDER_COLS)).alias("r"))
            .select(*keys, "r.*"))


def not_stored(winners: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``winners`` whose key is not in ``existing``.

    A plain ``left_anti`` can only broadcast its right side, i.e. the whole
    stored history, so every run would shuffle all stored keys.  Instead the
    stored keys that occur in the batch are found first (``left_semi`` of the
    history against the batch keys), then the batch is anti-joined against
    those hits, which are at most as many as the batch.  Whether the batch's
    keys are broadcast or shuffled is left to the planner, which knows their
    size at run time."""
    keys = list(keys)
    k = winners.select(*keys)
    hits = existing.select(*keys).join(k, keys, "left_semi")
    return winners.join(hits, keys, "left_anti")


def ingest_headlines(batch: DataFrame, existing: DataFrame | None = None,
                     keys: Sequence[str] = ("headline_hash",)) -> DataFrame:
    """Rows of ``batch`` that a first-wins unique store would insert.

    ``existing`` is the stored table (only its key columns are read).  The
    default key is the hash alone, so a story seen for two tickers is kept
    for the first one only; pass ``keys=("ticker", "headline_hash")`` to keep
    one per ticker.
    """
    winners = first_arrivals(batch, keys)
    if existing is not None:
        winners = not_stored(winners, existing, keys)
    return winners


def ingest_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row (inserted, skipped) with skipped = input - inserted."""
    total = batch.agg(F.count(F.lit(1)).alias("n"))
    ins = inserted.agg(F.count(F.lit(1)).alias("inserted"))
    # two one-row aggregates folded by a global aggregate (no join)
    both = total.unionByName(ins, allowMissingColumns=True).agg(
        F.max("n").alias("n"), F.max("inserted").alias("inserted"))
    return both.select(F.col("inserted"), (F.col("n") - F.col("inserted")).alias("skipped"))


def accounting_by_batch(records: DataFrame,
                        keys: Sequence[str] = ("headline_hash",)) -> DataFrame:
    """A6 over many runs at once: per ``batch_id``, how many records the run
    inserted (first arrival of their key across all runs) and skipped.

    Equal to running the runs one after another, without a driver loop: a
    record is inserted by its run iff it is the global first arrival.
    """
    keys = list(keys)
    if "headline_hash" not in records.columns:
        records = with_hash(records)
    valid = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in NOT_NULL))
    # the records are read once: one row per key and run, then the run of each
    # key's first arrival among those few
    runs = records.groupBy(*keys, "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(valid, F.struct(*ORDER_COLS))).alias("first"))
    least = F.min("first").over(Window.partitionBy(*keys))
    runs = runs.withColumn("won", F.col("first").isNotNull() & (F.col("first") == least))
    out = runs.groupBy("batch_id").agg(F.sum("n").alias("n"), F.count_if("won").alias("inserted"))
    return out.select("batch_id", "inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def ingest_runs(records: DataFrame, run: Column, keys: Sequence[str] = ("headline_hash",)) -> DataFrame:
    """S9/W2 over several runs at once, with the ``run`` that stored each row:
    runs follow each other in arrival order, so what a run inserts are the
    global first arrivals that fall into it.  One aggregate over the records
    read once, where run after run would look each other's keys up."""
    return first_arrivals(records.withColumn("run", run), keys)
