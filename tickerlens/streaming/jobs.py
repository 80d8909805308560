"""Structured Streaming jobs.

The reference polls on timers; here each job is a streaming query over
landed files with its own checkpoint.  Run it on a ``processingTime``
trigger for a service, or ``availableNow`` for a scheduled run.  Jobs talk
only through tables (R7), which exist, with a fixed schema, before a job runs.

Exactly-once without MERGE (H6): every micro-batch writes its rows under
``run=<query id>/batch_no=<id>`` with dynamic partition overwrite, and the
look-up of stored keys excludes that same partition, so a replayed batch
replaces itself.  The query id lives in the checkpoint: after a restart it is
the same, with a new checkpoint it is another one, so a new checkpoint never
overwrites stored rows.  All-time uniqueness lives in the table, not in state
(H5); ``stores`` keeps it cheap to look up.

Counters are observed in the pass that stages the rows and in the one that
writes them: no pass exists only to count.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import in_trading_hours
from ..operators.ingest import (first_arrivals, headline_records, hex_hash, not_stored, packed_hash,
                                with_hash, with_times)
from ..operators.prices import ingest_prices, log_return
from ..sources.feeds import BROKEN, FEED_SCHEMA, explode_articles
from ..sources.tables import COMMIT, JOB_LOG, create_if_absent, stream_schema
from . import stores
from .service import query_name
from .stores import Counts, commit, open_table, others

LATE_AFTER = "7 days"         # behind the newest row of earlier batches: late

LEDGER_SCHEMA = T.StructType([
    *JOB_LOG.fields,
    T.StructField("late", T.LongType()),
    T.StructField("newest", T.TimestampNTZType()),
    T.StructField("job", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("batch_no", T.LongType()),
    T.StructField("attempt", T.StringType()),
])

FEED_FILE_SCHEMA = T.StructType(FEED_SCHEMA.fields + [
    T.StructField("ticker", T.StringType()),
    T.StructField("ticker_pos", T.IntegerType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("page", T.LongType()),
])

BAR_FILE_SCHEMA = T.StructType([
    T.StructField("fetch_id", T.LongType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("market_date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("fetched_ts", T.TimestampNTZType()),
])

Body = Callable[[DataFrame, str, int], Counts]


def feed_rank() -> Column:
    """Arrival order inside a poll: page, then position in the response."""
    return F.shiftleft(F.col("page").cast("bigint"), 24) + F.col("feed_pos")


def _log(spark, path, name, counts, error, run, batch_no, attempt):
    """One ledger row.  A success has one partition per (job, run,
    batch), which a replay overwrites; every failure has a partition of its
    own, so it stays."""
    ran_at = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    row = spark.createDataFrame([(name, ran_at, int(counts.inserted), int(counts.skipped), error,
                                  int(counts.late), counts.newest, name, run, int(batch_no), attempt)],
                                LEDGER_SCHEMA)
    (row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("job", "run", "batch_no", "attempt").parquet(path))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    create_if_absent(spark, path, LEDGER_SCHEMA, ("job", "run", "batch_no", "attempt"))
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def late_before(spark: SparkSession, ledger_path: str | None, job: str, run: str, batch_no: int,
                after: str = LATE_AFTER) -> Column:
    """The publish time before which a row is late: ``after`` behind the
    newest one that earlier batches of the job logged; NULL before any did."""
    if not ledger_path:
        return F.lit(None).cast("timestamp_ntz")
    rows = others(read_ledger(spark, ledger_path).filter(F.col("job") == job), run, batch_no)
    newest = rows.agg(F.max("newest").alias("t")).first()["t"]
    return F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {after}")


class _RunId:
    """The id of the streaming query, known once it has started; the first
    micro-batch may begin before and waits for it."""

    def __init__(self):
        self._set, self._id = threading.Event(), ""

    def give(self, query):
        self._id = str(query.id)
        self._set.set()
        return query

    def get(self) -> str:
        if not self._set.wait(120):
            raise RuntimeError("the streaming query did not report its id")
        return self._id


def _guarded(name: str, ledger_path: str | None, body: Body, run_id: _RunId):
    """Run one micro-batch; log its counts or the failure (zeros, whole
    error).  A failure is re-raised so the query stops before its
    offsets commit and restarts from the checkpoint without losing the batch."""
    def run(batch: DataFrame, batch_no: int) -> None:
        spark, rid = batch.sparkSession, run_id.get()
        try:
            counts = body(batch, rid, batch_no)
        except Exception as exc:
            if ledger_path:
                _log(spark, ledger_path, name, Counts(), str(exc), rid, batch_no, uuid.uuid4().hex)
            raise
        if ledger_path:
            _log(spark, ledger_path, name, counts, None, rid, batch_no, "done")
    return run


def _start(stream: DataFrame, name: str, checkpoint: str, ledger_path: str | None, body: Body,
           trigger: dict | None):
    rid = _RunId()
    w = (stream.writeStream.queryName(query_name(name)).option("checkpointLocation", checkpoint)
         .foreachBatch(_guarded(name, ledger_path, body, rid)))
    return rid.give(w.trigger(**(trigger or {"availableNow": True})).start())


def batch_records(batch: DataFrame, as_of=None) -> DataFrame:
    """Headline records of a micro-batch of feed responses, with their hash."""
    arts = explode_articles(batch).withColumn("feed_rank", feed_rank())
    return with_hash(headline_records(arts, as_of=as_of), stripped=True)


def batch_winners(recs: DataFrame, as_of, keys: Sequence[str]) -> DataFrame:
    """First arrivals of a micro-batch with packed hashes; what follows from
    another column is not moved but derived again."""
    moved = [c for c in recs.columns if c not in ("published_ts", "market_date")]
    return with_times(first_arrivals(packed_hash(recs), keys, carry=moved), as_of)


def headline_batch(table_path: str, as_of=None, keys: Sequence[str] = ("headline_hash",),
                   ledger_path: str | None = None, digits: int = stores.PREFIX_DIGITS) -> Body:
    """R1/R5 body: feed responses -> keys of the records staged, and the records
    counted, in one pass -> first wins in batch -> keys stored under the batch's
    prefixes -> append.
    Late rows are accepted at any age and counted.  A batch without articles
    inserts and skips nothing.

    ``digits`` sets the partitions of the key table: few for scheduled runs whose
    batches touch them all, more for small batches over a large store."""
    def body(batch: DataFrame, run: str, batch_no: int) -> Counts:
        spark = batch.sparkSession
        table = open_table(spark, table_path, "headlines")
        recs = batch_records(batch, as_of)
        late = F.col("published_ts") < late_before(spark, ledger_path, "news_job", run, batch_no)
        slim, seen = stores.staged(
            packed_hash(recs.select(*keys, "published_ts", stores.prefix_of(keys[-1], digits).alias("prefix"))),
            f"{table_path.rstrip('/')}_staging/{run}", late=F.count_if(late),
            newest=F.max("published_ts"), prefixes=F.collect_set("prefix"))
        known = stores.stored_keys(spark, table_path, keys, seen["prefixes"], run, batch_no, digits)
        new = stores.unseen(batch_winners(recs, as_of, keys), slim, known, keys)
        ins = commit(hex_hash(new), table_path, "headlines", run, batch_no)
        stores.commit_keys(spark, table_path, keys, run, batch_no, digits)
        return Counts(ins, seen["n"] - ins, seen["late"], seen["newest"])
    return body


def quarantine_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_quarantine"


def read_quarantine(spark: SparkSession, table_path: str) -> DataFrame:
    """Text of the responses that could not be read, by micro-batch."""
    schema = T.StructType([T.StructField("text", T.StringType()), *COMMIT])
    create_if_absent(spark, quarantine_path(table_path), schema, stores.COMMIT_COLS)
    return spark.read.schema(schema).parquet(quarantine_path(table_path))


def with_quarantine(body: Body, table_path: str) -> Body:
    """A headline body whose broken responses are put aside first, under the
    micro-batch's own partition (a replay replaces them); the rest go on."""
    def run_body(batch: DataFrame, run: str, batch_no: int) -> Counts:
        rows = batch.filter(F.col(BROKEN).isNotNull()).select(
            F.col(BROKEN).alias("text"), F.lit(run).alias("run"), F.lit(batch_no).cast("bigint").alias("batch_no"))
        read_quarantine(batch.sparkSession, table_path)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*stores.COMMIT_COLS).parquet(quarantine_path(table_path)))
        return body(batch.filter(F.col(BROKEN).isNull()).drop(BROKEN), run, batch_no)
    return run_body


def start_headlines(spark: SparkSession, source_path: str, table_path: str,
                    checkpoint: str, ledger_path: str | None = None, as_of=None,
                    trigger: dict | None = None, max_files_per_trigger: int | None = None,
                    quarantine: bool = False, digits: int = stores.PREFIX_DIGITS):
    """Headline ingest stream over landed feed JSON files.

    No watermark: late articles are accepted at any age (R5).  With
    ``quarantine`` a response that is no JSON is put aside with its text
    (``read_quarantine``) instead of being read as one without articles."""
    open_table(spark, table_path, "headlines")
    body = headline_batch(table_path, as_of, ledger_path=ledger_path, digits=digits)
    reader = spark.readStream.schema(FEED_FILE_SCHEMA)
    if quarantine:
        body = with_quarantine(body, table_path)
        reader = (spark.readStream.schema(T.StructType([*FEED_FILE_SCHEMA.fields,
                                                        T.StructField(BROKEN, T.StringType())]))
                  .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _start(reader.json(source_path), "news_job", checkpoint, ledger_path,
                  body, trigger)


def bounded_batch(table_path: str, as_of=None, span_days: int = 7,
                  keys: Sequence[str] = ("headline_hash",)) -> Body:
    """R2 body: like R1, but a key is looked up only among the sessions from
    ``span_days`` before the batch's earliest one; what was stored for older
    sessions is forgotten, so a look-up never grows with history.  First wins in
    the batch; a row without a publish time belongs to the run's session and is
    treated like any other, and no row is dropped for its age."""
    def body(batch: DataFrame, run: str, batch_no: int) -> Counts:
        spark = batch.sparkSession
        open_table(spark, table_path, "headlines")
        recs = batch_records(batch, as_of)
        slim, seen = stores.staged(packed_hash(recs.select(*keys, "market_date", "published_ts")),
                                   f"{table_path.rstrip('/')}_staging/{run}",
                                   earliest=F.min("market_date"), newest=F.max("published_ts"))
        since = seen["earliest"] and seen["earliest"] - dt.timedelta(days=span_days)
        known = stores.recent_keys(spark, table_path, keys, since, run, batch_no)
        new = stores.unseen(batch_winners(recs, as_of, keys), slim, known, keys)
        ins = commit(hex_hash(new), table_path, "headlines", run, batch_no)
        stores.commit_day_keys(spark, table_path, keys, run, batch_no)
        return Counts(ins, seen["n"] - ins, 0, seen["newest"])
    return body


def start_bounded(spark: SparkSession, source_path: str, table_path: str, checkpoint: str,
                  ledger_path: str | None = None, as_of=None, trigger: dict | None = None,
                  span_days: int = 7):
    """R2: headline ingest that is unique within ``span_days`` only."""
    open_table(spark, table_path, "headlines")
    return _start(spark.readStream.schema(FEED_FILE_SCHEMA).json(source_path), "news_job", checkpoint,
                  ledger_path, bounded_batch(table_path, as_of, span_days), trigger)


def bounded_dedup(records: DataFrame, delay: str = "7 days",
                  ts: str = "published_ts", key: str = "headline_hash") -> DataFrame:
    """R2 as a streaming operator: dedup in Spark's state inside the watermark
    delay, for pipelines without a table.  Weaker than ``bounded_batch``: no first-wins order and rows older than the watermark drop.
    Watermarks need a TIMESTAMP column, so the UTC ``TIMESTAMP_NTZ`` is
    converted (UTC wall clock -> instant) first."""
    ev = F.col(ts).cast("timestamp")
    return (records.withColumn("event_time", ev)
            .withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark([key]).drop("event_time"))


def price_batch(table_path: str, policy: str = "first_wins", market_hours_only: bool = False) -> Body:
    """R3 body: fetched frames -> log returns inside each fetch (Q7) -> insert.

    ``fetch_id`` tells the fetches of a micro-batch apart.  ``first_wins``
    keeps the first stored row of a (ticker, date); ``last_wins`` appends, and
    ``operators.prices.latest_prices`` is the view of the last fetch.  With
    ``market_hours_only`` a fetch made outside regular trading hours (by its
    ``fetched_ts``, UTC) is left out, as the polling job does not run then."""
    def body(batch: DataFrame, run: str, batch_no: int) -> Counts:
        spark = batch.sparkSession
        open_table(spark, table_path, "prices")
        if market_hours_only:
            batch = batch.filter(F.col("fetched_ts").isNull() | in_trading_hours("fetched_ts"))
        bars, seen = stores.staged(batch.withColumn("fetch_ord", F.coalesce("fetch_id", F.lit(batch_no))),
                                   f"{table_path.rstrip('/')}_staging/{run}",
                                   n_valid=F.count_if(F.col("close").isNotNull() & ~F.isnan("close")),
                                   dates=F.collect_set("market_date"))
        fetched = log_return(bars, key=("fetch_ord", "ticker")).drop("fetch_id", "fetched_ts")
        known = others(stores.stored_prices(spark, table_path, seen["dates"]), run, batch_no)
        new = ingest_prices(fetched, known, policy=policy)
        ins = commit(new, table_path, "prices", run, batch_no)
        return Counts(ins, seen["n_valid"] - ins)
    return body


def start_prices(spark: SparkSession, source_path: str, table_path: str, checkpoint: str,
                 ledger_path: str | None = None, trigger: dict | None = None,
                 max_files_per_trigger: int | None = None, policy: str = "first_wins",
                 market_hours_only: bool = False):
    """Price ingest stream over landed long bar files; any number of
    fetches may share a micro-batch."""
    open_table(spark, table_path, "prices")
    reader = spark.readStream.schema(BAR_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _start(reader.parquet(source_path), "price_job", checkpoint, ledger_path,
                  price_batch(table_path, policy, market_hours_only), trigger)


def scoring_batch(headlines_path: str, scores_path: str,
                  scorer: Callable[[DataFrame], DataFrame] | None) -> Body:
    """R4 body: a drain.  Every run scores all stored headlines that have no
    score, whichever run stored them; what a run misses the next one scores.
    Without a model (``scorer`` None) nothing is scored."""
    def body(batch: DataFrame, run: str, batch_no: int) -> Counts:
        spark = batch.sparkSession
        if scorer is None:
            return Counts()
        done = others(open_table(spark, scores_path, "scores"), run, batch_no)
        stored = open_table(spark, headlines_path, "headlines")
        backlog = stored.select("headline_hash", "headline").dropDuplicates(["headline_hash"])
        if not done.isEmpty():        # a first run has nothing to look up
            backlog = not_stored(backlog, done, ["headline_hash"])
        scored = scorer(backlog).withColumn("score_seq", F.lit(batch_no).cast("bigint"))
        return Counts(commit(scored, scores_path, "scores", run, batch_no))
    return body


def start_scoring(spark: SparkSession, headlines_path: str, scores_path: str,
                  checkpoint: str, scorer: Callable[[DataFrame], DataFrame] | None,
                  ledger_path: str | None = None, trigger: dict | None = None,
                  source: str | None = None):
    """Score what the ingest stream stored; the two jobs share only
    tables, may start in any order and have separate checkpoints.  The job
    wakes when headlines are stored or, with ``source``, when feeds land."""
    open_table(spark, headlines_path, "headlines")
    open_table(spark, scores_path, "scores")
    if source:
        stream = spark.readStream.schema(FEED_FILE_SCHEMA).json(source)
    else:
        stream = spark.readStream.schema(stream_schema("headlines")).parquet(headlines_path)
    return _start(stream, "scoring_job", checkpoint, ledger_path,
                  scoring_batch(headlines_path, scores_path, scorer), trigger)
