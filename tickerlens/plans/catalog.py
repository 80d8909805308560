"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the
driver tables through ``sources.driver``.  DOUBLE outputs are rounded to 6
digits so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import in_trading_hours, session_date_ts
from ..session import scratch_path
from ..sources import driver
from . import common as C

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- prices ----

@register("session_date")
def q_session_date(spark, sf_dir):
    """F5 on every event instant."""
    ev = driver.table(spark, sf_dir, "events")
    return ev.select("event_id", session_date_ts("ts").alias("market_date"))


@register("market_hours")
def q_market_hours(spark, sf_dir):
    """P4 as a column: ticks inside regular trading hours, per ticker."""
    t = driver.ticks(spark, sf_dir)
    return (t.groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("n_ticks"),
                 F.count_if(in_trading_hours("ts")).alias("n_in_hours")))


@register("ohlcv_bars")
def q_ohlcv_bars(spark, sf_dir):
    return C.round_doubles(C.bars(spark, sf_dir))


@register("log_return")
def q_log_return(spark, sf_dir):
    return C.round_doubles(C.returns(spark, sf_dir))


# ----------------------------------------------------------- sources ----

from ..functions.numeric import safe_bigint, safe_double  # noqa: E402
from ..functions.text import source_of  # noqa: E402
from ..operators import health as H  # noqa: E402
from ..operators.ingest import accounting_by_batch, ingest_runs  # noqa: E402
from ..operators.prices import pivot_prices, price_window, unpivot_prices  # noqa: E402
from ..operators.scoring import unscored, with_latest_scores  # noqa: E402
from ..sources import feeds  # noqa: E402


@register("articles_parse")
def q_articles_parse(spark, sf_dir):
    """Article rows -> paged JSON responses -> parsed and exploded."""
    pages = feeds.build_feed_pages(driver.article_rows(spark, sf_dir))
    arts = feeds.explode_articles(feeds.parse_feed(pages.drop("page")))
    return arts.select("ticker", "batch_id", "title", "url", "published_at", "source_name")


@register("feed_topk")
def q_feed_topk(spark, sf_dir):
    """Newest 20 English articles per ticker in the 7-day window."""
    w = feeds.feed_window(driver.article_rows(spark, sf_dir), C.FEED_AS_OF)
    return w.select("ticker", "feed_rank", "rank", "published_at")


@register("topic_lookup")
def q_topic_lookup(spark, sf_dir):
    """Ticker -> search query (default: the ticker) for every article."""
    a = driver.titles(spark, sf_dir).select("doc_id", "ticker")
    return a.join(F.broadcast(C.topics(spark).select("ticker", "query")), "ticker", "left") \
        .select("doc_id", "ticker", F.coalesce("query", "ticker").alias("query"))


@register("feed_union")
def q_feed_union(spark, sf_dir):
    """Per-ticker search results (any query term) in ticker order."""
    f = feeds.fan_out(driver.titles(spark, sf_dir), C.topics(spark))
    return f.select("doc_id", "ticker", "ticker_pos")


@register("topic_match")
def q_topic_match(spark, sf_dir):
    """Headlines matching *all* terms of a ticker's query."""
    a = driver.titles(spark, sf_dir).select("doc_id", "title")
    return feeds.topic_match(a, C.topics(spark), text="title", mode="all")


@register("title_clean")
def q_title_clean(spark, sf_dir):
    """Cleaned titles, removed/empty ones dropped."""
    return C.records(spark, sf_dir).select("feed_rank", "ticker", "headline")


@register("source_normalize")
def q_source_normalize(spark, sf_dir):
    """F3 in both strip modes."""
    a = driver.article_rows(spark, sf_dir)
    return a.select("doc_id", source_of("source_name", "url").alias("source"),
                    source_of("source_name", "url", "prefix").alias("source_prefix"))


@register("headline_hash")
def q_headline_hash(spark, sf_dir):
    return C.records(spark, sf_dir).select("feed_rank", "headline_hash")


@register("headline_dedup")
def q_headline_dedup(spark, sf_dir):
    """Two ingest runs split on a poll-slot edge; the second run
    inserts only hashes the first did not store."""
    run = F.when(F.col("batch_id") < C.cut_slot(), 1).otherwise(2)
    return ingest_runs(C.records(spark, sf_dir), run).select("headline_hash", "ticker", "headline", "source", "raw_timestamp",
                      "market_date", "feed_rank", "run")


@register("ingest_accounting")
def q_ingest_accounting(spark, sf_dir):
    """Inserted / skipped per ingest run (poll slot)."""
    return accounting_by_batch(C.records(spark, sf_dir))


@register("price_dedup")
def q_price_dedup(spark, sf_dir):
    """Two fetches, first wins per (ticker, market_date)."""
    return C.round_doubles(C.stored_prices(spark, sf_dir))


@register("price_window")
def q_price_window(spark, sf_dir):
    """Bars in [as_of - 14, as_of + 1), read from the store, which is
    partitioned by date."""
    from ..streaming.stores import write_prices
    bars = C.returns(spark, sf_dir)
    stored = write_prices(bars, scratch_path(spark, f"tickerlens/prices-{uuid.uuid4().hex}"))
    return C.round_doubles(price_window(stored, C.PRICE_AS_OF).select(*bars.columns))


@register("prices_unpivot")
def q_prices_unpivot(spark, sf_dir):
    """Bars pivoted to the wide download shape and back to long."""
    wide = pivot_prices(C.bars(spark, sf_dir), C.TICKERS)
    long = unpivot_prices(wide, C.TICKERS)
    return C.round_doubles(long.filter(F.col("close").isNotNull() & ~F.isnan("close")))


@register("safe_numeric")
def q_safe_numeric(spark, sf_dir):
    """F7/F8 on tick-derived values; every 7th tick carries NaN."""
    t = driver.ticks(spark, sf_dir)
    x = F.when(F.col("tick_id") % 7 == 0, F.lit(float("nan"))).otherwise(
        F.col("price") * 10.0 - 1000.0)
    return C.round_doubles(t.select("tick_id", safe_double(x).alias("as_double"),
                                    safe_bigint(x).alias("as_bigint")))


# ------------------------------------------------------------ scoring ----

@register("score_merge")
def q_score_merge(spark, sf_dir):
    """Stored headlines with their latest score (NULL if none)."""
    s = with_latest_scores(C.stored_headlines(spark, sf_dir), C.scores(spark, sf_dir))
    return C.round_doubles(s.select("headline_hash", "ticker", "sentiment_label",
                                    "confidence", "model_version"))


@register("unscored_backlog")
def q_unscored_backlog(spark, sf_dir):
    """The 200 oldest unscored headlines."""
    b = unscored(C.stored_headlines(spark, sf_dir), C.scores(spark, sf_dir),
                 limit=C.BACKLOG_LIMIT)
    return b.select("headline_hash", "ticker", "headline", "batch_id", "ticker_pos",
                    "feed_rank")


# ------------------------------------------------------------- health ----

@register("health_summary")
def q_health_summary(spark, sf_dir):
    """A1/A2: counts and newest values by arrival."""
    return H.health_summary(C.scored_headlines(spark, sf_dir), C.stored_prices(spark, sf_dir))


@register("health_card")
def q_health_card(spark, sf_dir):
    """the health counts as status-card text (thousands separators)."""
    return H.health_card(H.health_summary(C.scored_headlines(spark, sf_dir),
                                          C.stored_prices(spark, sf_dir)))


@register("recent_headlines")
def q_recent_headlines(spark, sf_dir):
    """10 newest stored headlines."""
    return H.recent(C.stored_headlines(spark, sf_dir), 10,
                    ["ticker", "market_date", "headline", "source"],
                    ["batch_id", "ticker_pos", "feed_rank"])


@register("job_log_append")
def q_job_log_append(spark, sf_dir):
    """The job ledger."""
    return H.job_ledger(driver.job_runs(spark, sf_dir))


@register("recent_jobs")
def q_recent_jobs(spark, sf_dir):
    """10 newest ledger rows with error text (health view)."""
    return H.recent(H.job_ledger(driver.job_runs(spark, sf_dir)), 10,
                    ["job_name", "ran_at", "inserted", "skipped", "error"], ["run_id"])


# ---------------------------------------------------------- analytics ----

from ..operators import analytics as A  # noqa: E402


@register("daily_sentiment")
def q_daily_sentiment(spark, sf_dir):
    return C.round_doubles(C.daily(spark, sf_dir))


@register("sentiment_price_join")
def q_sentiment_price_join(spark, sf_dir):
    return C.round_doubles(A.sentiment_price_join(C.daily(spark, sf_dir),
                                                  C.returns(spark, sf_dir)))


@register("bucketed_join")
def q_bucketed_join(spark, sf_dir):
    """J4 on its index: both sides stored in buckets of (ticker, market_date),
    joined bucket against bucket."""
    from ..sources.bucketed import index_sessions, indexed_join
    name = f"tickerlens_{uuid.uuid4().hex}"
    daily, bars = index_sessions(C.daily(spark, sf_dir), C.returns(spark, sf_dir), name,
                                 scratch_path(spark, f"tickerlens/{name}"))
    return C.round_doubles(indexed_join(daily, bars))


@register("rolling_pearson")
def q_rolling_pearson(spark, sf_dir):
    j = A.sentiment_price_join(C.daily(spark, sf_dir), C.returns(spark, sf_dir))
    return C.round_doubles(A.rolling_pearson(j, C.ROLL_WINDOW))


def _spikes(spark, sf_dir):
    daily = A.daily_sentiment(C.scored_headlines(spark, sf_dir), first_published="published_ts")
    return A.sentiment_spikes(daily, C.SPIKE_LOOKBACK, C.SPIKE_MIN_HISTORY, C.SPIKE_K)


@register("event_study")
def q_event_study(spark, sf_dir):
    """Forward returns after sentiment spikes, per horizon and sign."""
    return C.round_doubles(A.event_study(_spikes(spark, sf_dir),
                                         driver.ticks(spark, sf_dir), C.HORIZONS,
                                         cell_seconds=C.ASOF_CELL_SECONDS))


# ------------------------------------------------------------ corpus ----

from ..functions.model import keyword_without_stopwords  # noqa: E402
from ..operators import corpus as K  # noqa: E402
from ..operators import ml as M  # noqa: E402


@register("corpus_parse")
def q_corpus_parse(spark, sf_dir):
    """sentence@label lines -> (sentence, label)."""
    return C.corpus(spark, sf_dir).select("line_no", "sentence", "label")


@register("corpus_audit")
def q_corpus_audit(spark, sf_dir):
    """Malformed / unknown-label counters in one pass."""
    return K.corpus_audit(driver.corpus_lines(spark, sf_dir))


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    """A3: class balance audit."""
    return C.round_doubles(K.class_distribution(C.corpus(spark, sf_dir)))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    """Exact 70/15/15 stratified split, counted per split and label."""
    return C.splits(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("split_ratios")
def q_split_ratios(spark, sf_dir):
    """A4: class shares per split."""
    return C.round_doubles(K.split_ratios(C.splits(spark, sf_dir)))


@register("split_roundtrip")
def q_split_roundtrip(spark, sf_dir):
    """Splits written partitioned by split, read back, counted."""
    back = K.split_roundtrip(C.splits(spark, sf_dir), scratch_path(spark, "tickerlens"))
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("tokenize")
def q_tokenize(spark, sf_dir):
    """M2: truncated lower-case tokens of every corpus sentence."""
    return M.tokenize(C.corpus(spark, sf_dir), max_len=512).select("line_no", "label", "tokens")


# ------------------------------------------------------- model decode ----

@register("logits_decode")
def q_logits_decode(spark, sf_dir):
    """softmax / argmax / confidence of model logits."""
    from ..functions.model import decode_logits
    o = driver.embedding_logits(spark, sf_dir)
    x = decode_logits("logits")
    return C.round_doubles(o.select("doc_id", x["pred"].alias("pred"), x["label"].alias("label"),
                                    x["confidence"].alias("confidence")))


@register("attention_keyword")
def q_attention_keyword(spark, sf_dir):
    """most-attended token of the CLS row (mean over heads)."""
    from ..functions.model import attention_keyword
    o = driver.model_outputs(spark, sf_dir)
    return o.select("doc_id", "window",
                    attention_keyword("tokens", "attention", "length").alias("keyword"))


@register("keyword_stopwords")
def q_keyword_stopwords(spark, sf_dir):
    """Attention keyword with stop words excluded."""
    o = driver.model_outputs(spark, sf_dir)
    return o.select("doc_id", "window", keyword_without_stopwords(
        "tokens", "attention", "length", C.STOP_WORDS).alias("keyword"))


@register("macro_metrics")
def q_macro_metrics(spark, sf_dir):
    """A5: argmax of model logits against the labels."""
    from ..functions.model import decode_logits
    o = driver.embedding_logits(spark, sf_dir).select("doc_id", decode_logits("logits")["pred"]
                                                      .alias("prediction"))
    j = o.join(driver.label_of_doc(spark, sf_dir), "doc_id")
    return C.round_doubles(M.macro_metrics(j, "label", "prediction"))


def _trained(spark, sf_dir):
    # the split (several shuffles) feeds every ML pass: materialise it once
    # with a reliable checkpoint in the shared checkpoint folder, which also
    # cuts the lineage an executor loss would otherwise replay
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    s = C.splits(spark, sf_dir).checkpoint(eager=True)
    train = s.filter(F.col("split") == "train")
    val = s.filter(F.col("split") == "validation")
    return M.train_select(train, val), s


@register("train_select")
def q_train_select(spark, sf_dir):
    """M3: grid of regularisation values, best by validation macro-F1."""
    (_, report), _ = _trained(spark, sf_dir)
    return report


@register("train_eval")
def q_train_eval(spark, sf_dir):
    """M4: held-out test metrics of the selected model."""
    (model, _), s = _trained(spark, sf_dir)
    return M.evaluate(model, s.filter(F.col("split") == "test"))


@register("scoring_drain")
def q_scoring_drain(spark, sf_dir):
    """M1/L2: score the whole unscored backlog with the selected model, saved
    and loaded as a scoring job does."""
    from ..operators.scoring import score_with_pipeline
    (model, _), _ = _trained(spark, sf_dir)
    path = f"{scratch_path(spark, 'tickerlens/model')}-{uuid.uuid4().hex}"
    M.save_model(model, path)
    model = M.load_model(spark, path)
    backlog = unscored(C.stored_headlines(spark, sf_dir, carry=("headline",)), C.scores(spark, sf_dir))
    return score_with_pipeline(backlog.select("headline_hash", "headline"), model,
                               M.model_version(model), text="headline").drop("model_version")


def _epochs(spark, sf_dir):
    """Corpus rows dealt by digest (70 / 15 / 15) and trained for 3 epochs."""
    from ..operators import epochs as E
    plan, base = E.Plan(), scratch_path(spark, f"tickerlens/epochs-{uuid.uuid4().hex}")
    part = E.digest_number(F.concat(F.lit("split:"), F.col("line_no").cast("string"))) % 100
    subset = F.when(part < 70, "train").when(part < 85, "validation").when(part >= 85, "test")
    rows = E.store_rows(E.hashed_rows(C.corpus(spark, sf_dir), plan), f"{base}/stored", subset)
    weights, report = E.train_epochs(rows.filter("subset = 'train'"), rows.filter("subset = 'validation'"),
                                     base, plan, stored=True)
    return weights, report, rows.filter("subset = 'test'")


@register("train_epochs")
def q_train_epochs(spark, sf_dir):
    """M3: loss and validation metrics of every epoch, the best one marked."""
    return C.round_doubles(_epochs(spark, sf_dir)[1])


@register("epoch_eval")
def q_epoch_eval(spark, sf_dir):
    """M4: test metrics of the best epoch."""
    from ..operators.epochs import predict
    weights, _, test = _epochs(spark, sf_dir)
    return C.round_doubles(M.macro_metrics(predict(test, weights)))


@register("epoch_drain")
def q_epoch_drain(spark, sf_dir):
    """M1/L2: the whole unscored backlog through the Arrow scorer, with the
    weights of the best epoch."""
    from ..operators.epochs import EpochScorer
    from ..operators.scoring import score_in_pandas
    weights, _, _ = _epochs(spark, sf_dir)
    backlog = unscored(C.stored_headlines(spark, sf_dir, carry=("headline",)), C.scores(spark, sf_dir))
    out = score_in_pandas(backlog, EpochScorer(weights), model_version="epochs")
    return C.round_doubles(out.select("headline_hash", "sentiment_label", "confidence"))


@register("corpus_files")
def q_corpus_files(spark, sf_dir):
    """The corpus written as a text file and read back as one."""
    path = scratch_path(spark, f"tickerlens/corpus-{uuid.uuid4().hex}")
    driver.corpus_lines(spark, sf_dir).select("value").write.option("lineSep", "\n").text(path)
    return K.parse_corpus(K.read_corpus(spark, path, "UTF-8")).select("sentence", "label")


# ---------------------------------------------------------- streaming ----

from ..streaming import jobs as R  # noqa: E402


def _stream_base(spark) -> str:
    return scratch_path(spark, f"tickerlens/stream-{uuid.uuid4().hex}")


def _feed_pages(spark, sf_dir):
    """Feed pages of all articles; documents are moved whole and opened last."""
    return feeds.build_feed_pages(driver.article_docs(spark, sf_dir), opened=driver.open_articles,
                                  n_rows=F.col("n_lines"))


def _write_feeds(spark, sf_dir, base: str) -> None:
    """Write the feed pages of both scheduled runs beside the watched folder.
    Pages never mix batches, so one pass over the texts makes them all."""
    pages = feeds.feed_documents(_feed_pages(spark, sf_dir)).withColumn("first", F.col("batch_id") < C.cut_slot())
    pages.write.option("compression", "gzip").partitionBy("first").json(f"{base}/out")


def _land_feeds(spark, base: str, first: bool) -> None:
    """Land the feed pages of one scheduled run (before / after the cut)."""
    run = str(first).lower()
    feeds.land(spark, f"{base}/out/first={run}", f"{base}/in", f"first-{run}")


def _run_headline_stream(spark, sf_dir, base: str, order=(True, False)) -> str:
    in_dir, table = f"{base}/in", f"{base}/headlines"
    _write_feeds(spark, sf_dir, base)
    for first in order:                  # two scheduled runs of the job
        _land_feeds(spark, base, first)
        q = R.start_headlines(spark, in_dir, table, f"{base}/ckpt", f"{base}/ledger",
                              as_of=C.AS_OF)
        q.awaitTermination()
    return table


@register("stream_headlines")
def q_stream_headlines(spark, sf_dir):
    """Headline ingest stream, two availableNow runs."""
    table = _run_headline_stream(spark, sf_dir, _stream_base(spark))
    return spark.read.parquet(table).select("headline_hash", "ticker", "headline", "source",
                                            "raw_timestamp", "market_date")


@register("stream_ledger")
def q_stream_ledger(spark, sf_dir):
    """The ledger rows the headline stream wrote (one per micro-batch)."""
    base = _stream_base(spark)
    _run_headline_stream(spark, sf_dir, base)
    return R.read_ledger(spark, f"{base}/ledger").select(
        "job_name", "inserted", "skipped", "late", "error", "batch_no")


@register("stream_late_rows")
def q_stream_late_rows(spark, sf_dir):
    """The newer half of the feed lands first, the older half after it; the
    late rows are stored all the same and counted in the ledger."""
    base = _stream_base(spark)
    _run_headline_stream(spark, sf_dir, base, order=(False, True))
    return R.read_ledger(spark, f"{base}/ledger").select(
        "inserted", "skipped", "late", "newest", "batch_no")


@register("stream_dedup_bounded")
def q_stream_dedup_bounded(spark, sf_dir):
    """R2: two runs whose look-up goes back seven days before the batch."""
    base = _stream_base(spark)
    _write_feeds(spark, sf_dir, base)
    for first in (True, False):
        _land_feeds(spark, base, first)
        R.start_bounded(spark, f"{base}/in", f"{base}/headlines", f"{base}/ckpt",
                        as_of=C.AS_OF).awaitTermination()
    return R.open_table(spark, f"{base}/headlines", "headlines").select(
        "headline_hash", "ticker", "published_ts", "market_date", "batch_no")


@register("newest_stored")
def q_newest_stored(spark, sf_dir):
    """P8 on the stream's table: 10 newest rows, read from the newest commits."""
    from ..streaming.stores import newest_rows
    base = _stream_base(spark)
    table = _run_headline_stream(spark, sf_dir, base)
    return newest_rows(spark, table, "headlines", R.read_ledger(spark, f"{base}/ledger"), 10,
                       ["batch_id", "ticker_pos", "feed_rank"]).select(
        "ticker", "market_date", "headline", "source")


@register("health_stored")
def q_health_stored(spark, sf_dir):
    """Totals of the stored tables from file footers; every hash whose
    first digit is below 8 is scored twice, and the scores are compacted."""
    from ..sources.tables import PRICES, SCORES, stream_schema
    from ..streaming import compaction as Z
    base = _stream_base(spark)
    table = _run_headline_stream(spark, sf_dir, base)

    def scorer(label):
        def run(backlog):
            return backlog.filter(F.col("headline_hash") < "8").select(
                "headline_hash", F.lit(label).alias("sentiment_label"), F.lit(1.0).alias("confidence"),
                F.lit(None).cast("string").alias("attention_keyword"), F.lit("rule").alias("model_version"))
        return run
    R.start_scoring(spark, table, f"{base}/scores", f"{base}/c-score", scorer("neutral")).awaitTermination()
    # a second opinion on the same headlines, as a later model version writes it
    again = scorer("positive")(spark.read.parquet(table)).withColumn("score_seq", F.lit(1).cast("bigint"))
    R.commit(again, f"{base}/scores", "scores", "second", 0)
    gen = Z.compact(spark, f"{base}/scores")
    from ..streaming.stores import write_prices
    write_prices(C.returns(spark, sf_dir), f"{base}/prices")
    s = H.footer_session(spark)
    h = H.footer_totals(s, table, stream_schema("headlines"), "market_date").first()
    scored = H.footer_totals(s, Z.snapshot_path(f"{base}/scores", gen), SCORES).first()["n"]
    p = H.footer_totals(s, f"{base}/prices", PRICES).first()["n"]
    positive = Z.effective_scores(spark, f"{base}/scores").agg(F.count_if(F.col("sentiment_label") == "positive"))
    return spark.createDataFrame(
        [(h["n"], scored, h["n"] - scored, h["newest"], p, positive.first()[0])],
        "total_headlines bigint, scored_headlines bigint, unscored_headlines bigint, newest_session date, "
        "total_price_records bigint, n_positive bigint")


@register("stream_service")
def q_stream_service(spark, sf_dir):
    """News, price and scoring jobs side by side, the scorer broken; the
    ledger rows of all three."""
    from ..operators.prices import ohlcv_bars
    from ..streaming.service import Service
    base = _stream_base(spark)
    _write_feeds(spark, sf_dir, base)
    for first in (True, False):
        _land_feeds(spark, base, first)
    ohlcv_bars(driver.ticks(spark, sf_dir)).withColumns({
        "fetch_id": F.lit(0).cast("bigint"), "fetched_ts": F.lit(None).cast("timestamp_ntz"),
    }).write.parquet(f"{base}/bars")
    R.open_table(spark, f"{base}/headlines", "headlines")

    def broken(backlog):
        raise ValueError("the scorer does not load")
    jobs = Service(spark, f"{base}/events", restarts=1)
    ledger = f"{base}/ledger"
    jobs.add("news_job", lambda: R.start_headlines(spark, f"{base}/in", f"{base}/headlines", f"{base}/c-news",
                                                   ledger, as_of=C.AS_OF))
    jobs.add("price_job", lambda: R.start_prices(spark, f"{base}/bars", f"{base}/prices", f"{base}/c-price",
                                                 ledger))
    # fed by the landed files, so it has a micro-batch whenever it starts
    jobs.add("scoring_job", lambda: R.start_scoring(spark, f"{base}/headlines", f"{base}/scores",
                                                    f"{base}/c-score", broken, ledger, source=f"{base}/in"))
    jobs.run()
    return R.read_ledger(spark, ledger).select(
        "job_name", "inserted", "skipped",
        F.col("error").contains("the scorer does not load").alias("broken"))


def _damaged_feeds(spark, sf_dir):
    """Feed responses as landed text lines; every fifth is cut short."""
    pages = feeds.feed_documents(_feed_pages(spark, sf_dir))
    text = F.to_json(F.struct("ticker", "ticker_pos", "batch_id", "page", "articles"))
    cut = (F.col("page") + F.col("ticker_pos") + F.col("batch_id")) % C.DAMAGED_EVERY == 0
    return pages.select("ticker", F.when(cut, F.substring(text, F.lit(1), F.length(text) - 5))
                        .otherwise(text).alias("value"))


@register("feed_quarantine")
def q_feed_quarantine(spark, sf_dir):
    """Usable and broken responses per ticker, and the articles read."""
    checked = feeds.checked_feed(_damaged_feeds(spark, sf_dir))
    return checked.groupBy("ticker").agg(
        F.count("*").alias("n_responses"), F.count("reason").alias("n_broken"),
        F.sum(F.coalesce(F.size("articles"), F.lit(0))).cast("bigint").alias("n_articles"))


@register("stream_quarantine")
def q_stream_quarantine(spark, sf_dir):
    """The headline stream over a feed with broken responses; they are
    put aside, the others are stored."""
    base = _stream_base(spark)
    _damaged_feeds(spark, sf_dir).select("value").write.option("compression", "gzip").text(f"{base}/in")
    table = f"{base}/headlines"
    R.start_headlines(spark, f"{base}/in", table, f"{base}/ckpt", f"{base}/ledger", as_of=C.AS_OF,
                      quarantine=True).awaitTermination()
    aside = R.read_quarantine(spark, table).groupBy("run", "batch_no").agg(F.count("*").alias("n_broken"))
    return R.read_ledger(spark, f"{base}/ledger").join(aside, ["run", "batch_no"], "left").select(
        "batch_no", "inserted", "skipped", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))


@register("stream_prices")
def q_stream_prices(spark, sf_dir):
    """Two price fetches landed and ingested by one stream run."""
    from ..operators.prices import ohlcv_bars
    base = _stream_base(spark)
    in_dir, table = f"{base}/in", f"{base}/prices"
    t = driver.ticks(spark, sf_dir)
    fetches = [t.filter(F.col("ts") < F.lit(C.PRICE_CUT).cast("timestamp_ntz")), t]
    for k, f in enumerate(fetches):      # both fetches share one micro-batch
        bars = ohlcv_bars(f).withColumns({
            "fetch_id": F.lit(k).cast("bigint"), "fetched_ts": F.lit(None).cast("timestamp_ntz")})
        bars.write.mode("append").parquet(in_dir)
    R.start_prices(spark, in_dir, table, f"{base}/ckpt", f"{base}/ledger").awaitTermination()
    out = spark.read.parquet(table).select(
        "ticker", "market_date", "open", "high", "low", "close", "volume", "daily_return",
        (F.col("fetch_ord") + 1).alias("fetch_ord"))
    return C.round_doubles(out)


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    """Scoring stream over the stored headlines table; the scorer
    decodes the model outputs of all windows of each headline (F11/F12)."""
    from ..operators.scoring import decode_windows
    base = _stream_base(spark)
    table = _run_headline_stream(spark, sf_dir, base)

    def scorer(backlog):
        return decode_windows(driver.model_outputs(spark, sf_dir, backlog), "embeddings")

    q = R.start_scoring(spark, table, f"{base}/scores", f"{base}/ckpt-score", scorer,
                        f"{base}/ledger")
    q.awaitTermination()
    return C.round_doubles(spark.read.parquet(f"{base}/scores").select(
        "headline_hash", "sentiment_label", "confidence", "attention_keyword"))
