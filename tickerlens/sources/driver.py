"""Adapters from the driver's parquet tables to the domain frames.

The driver tables are generic (events, documents, pages, labels,
embeddings); these functions give them the shapes the pipeline works on.
Every adapter is a projection/join over the whole table, so work grows with
the data.  The SQL twins of these adapters live in ``plans.oracle``.

| domain        | built from                                                 |
|---------------|------------------------------------------------------------|
| ticker        | ``T%02d`` of ``pmod(user_id, 20)`` / ``pmod(doc_id, 20)``  |
| ticks         | events: ticker, ts (UTC), value as price, event_id         |
| article rows  | every line of a document as title, publish time from the   |
|               | event with ``event_id = doc_id * 5``, URL from pages       |
| human scores  | labels: toxic -> negative, quality -> positive, else       |
|               | neutral                                                    |
| model outputs | embeddings: first 3 floats = logits, 64 floats = 4 heads x |
|               | 16 positions of CLS attention, tokens from the headline    |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import word_tokens, wordpiece_frame
from ..functions.text import ustrip
from ..functions.time import iso_seconds_z

# --- fixed values (adapter parameters, our choice) --------------------------
N_TICKERS = 20
DOC_EVENT_STRIDE = 5          # headline publish time = ts of event doc_id * 5
POLL_HOURS = 4                # news poll interval: one ingest batch per slot
SEQ_LEN = 16                  # positions per attention row in embeddings
N_HEADS = 4
N_LOGITS = 3
LINE_STRIDE = 1 << 27         # line ids of a document start at doc_id * stride
JOB_NAMES = ("news_job", "price_job", "scoring_job")
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticker_of(k: Column | str) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.format_string("T%02d", F.pmod(k, F.lit(N_TICKERS)))


def ticker_pos_of(k: Column | str) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.pmod(k, F.lit(N_TICKERS)).cast("int")


def poll_slot(ts: Column | str) -> Column:
    """Index of the ``POLL_HOURS`` slot holding a UTC timestamp (NTZ)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
            * (24 // POLL_HOURS)
            + F.floor(F.hour(ts) / POLL_HOURS).cast("bigint"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday price ticks: ticker, ts (UTC NTZ), price, tick_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(ticker_of("user_id").alias("ticker"), F.col("ts"),
                     F.col("value").alias("price"),
                     F.col("event_id").alias("tick_id"))


def line_id(doc: Column, pos: Column) -> Column:
    """Identity of one line of a document (ids in text order)."""
    return (doc * LINE_STRIDE + pos).cast("bigint")


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of ``text``: ``doc`` (document id), ``pos`` (line in
    it, from 0), ``doc_id`` (line id) and ``title`` (the line)."""
    keep = [c for c in docs.columns if c not in ("doc_id", text)]
    return docs.select(*keep, F.col("doc_id").alias("doc"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "title")) \
        .withColumn("doc_id", line_id(F.col("doc"), F.col("pos")))


def article_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the publish time and URL that all their lines share:
    doc_id, lang, text, n_lines (counted before the text is moved), and the
    columns of ``article_rows`` that do not depend on the line."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "text",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    stride = F.lit(DOC_EVENT_STRIDE)
    ev = table(spark, sf_dir, "events").filter(F.col("event_id") % stride == 0).select(
        (F.expr(f"event_id DIV {DOC_EVENT_STRIDE}")).alias("ev_doc"), F.col("ts").alias("pub_ts"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.col("url"))
    # time and URL meet first, without a text, so a text is shuffled by one key
    side = ev.join(pages, ev.ev_doc == pages.page_id, "full").select(
        F.coalesce("ev_doc", "page_id").alias("side_doc"), "pub_ts", "url")
    joined = docs.join(side, docs.doc_id == side.side_doc, "left")
    return joined.select(
        "doc_id", "lang", "text", "n_lines",
        ticker_of("doc_id").alias("ticker"),
        ticker_pos_of("doc_id").alias("ticker_pos"),
        "url",
        iso_seconds_z("pub_ts").alias("published_at"),
        F.coalesce(poll_slot("pub_ts"), F.lit(0).cast("bigint")).alias("batch_id"),
        F.col("pub_ts").alias("published_raw"),
    )


def open_articles(docs: DataFrame) -> DataFrame:
    """``article_docs`` -> one article row per line."""
    return with_lines(docs).select(
        "doc_id", "lang", "ticker", "ticker_pos", "title",
        F.lit(None).cast("string").alias("source_name"),
        "url", "published_at", "batch_id",
        F.col("doc_id").alias("feed_rank"), "published_raw")


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw article rows as a feed would deliver them (before cleaning).

    Every line of every document is an article.  Columns: doc_id (line id),
    lang, ticker, ticker_pos, title, source_name, url, published_at (raw ISO
    text, may be NULL), batch_id, feed_rank (line id), published_raw (the time
    itself).
    """
    # lines open after the joins, so a document is shuffled once, not per line
    return open_articles(article_docs(spark, sf_dir))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without publish time and URL (no join): doc_id, lang,
    ticker, ticker_pos, title."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return with_lines(docs).select("doc_id", "lang", ticker_of("doc").alias("ticker"),
                                   ticker_pos_of("doc").alias("ticker_pos"), "title")


def human_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows from ``labels`` keyed by the headline hash of the doc.

    Columns: headline_hash, sentiment_label, confidence, attention_keyword,
    model_version, score_seq (write order; later writes win).
    """
    from ..functions.text import headline_hash

    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    label = (F.when(F.col("toxic") == 1, F.lit("negative"))
             .when(F.col("quality") == 1, F.lit("positive"))
             .otherwise(F.lit("neutral")))
    return (with_lines(lab.join(docs, "doc_id"))
            .select(headline_hash(F.coalesce(F.col("title"), F.lit(""))).alias("headline_hash"),
                    label.alias("sentiment_label"),
                    F.lit(1.0).alias("confidence"),
                    F.lit(None).cast("string").alias("attention_keyword"),
                    F.lit("labels").alias("model_version"),
                    F.col("doc_id").alias("score_seq")))


def embedding_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (document) and logits of every model output; no text is read."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("doc_id"),
                      F.slice(F.col("embedding").cast("array<double>"), 1, N_LOGITS).alias("logits"))


def model_outputs(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Model outputs of every headline: logits, padded tokens, CLS attention.

    A headline longer than a sequence is seen in consecutive windows, so every
    token is covered.  With ``wanted(headline_hash)`` only the first line of
    each of these hashes: lines are hashed and reduced to those before any
    window is opened or any embedding read for them.  Columns: doc_id (line
    id), window (from 0), headline_hash, logits array<double>, tokens
    array<string>, attention array<array<double>>, length int.
    """
    from ..functions.text import headline_hash

    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = F.col("embedding").cast("array<double>")
    heads = F.array(*[F.slice(e, 1 + h * SEQ_LEN, SEQ_LEN) for h in range(N_HEADS)])
    if wanted is None:
        lines = with_lines(emb.join(docs, emb.vec_id == docs.doc_id).select("doc_id", "embedding", "text"))
        lines = lines.withColumn("title", F.coalesce("title", F.lit("")))
        lines = lines.withColumn("headline_hash", headline_hash("title"))
    else:
        lines = with_lines(docs.join(emb.select("vec_id"), docs.doc_id == F.col("vec_id"), "left_semi"))
        lines = lines.withColumn("title", F.coalesce("title", F.lit("")))
        lines = lines.select(headline_hash("title").alias("headline_hash"), "doc_id", "doc", "title")
        lines = lines.join(wanted.select("headline_hash"), "headline_hash", "left_semi")
        first = lines.groupBy("headline_hash").agg(F.min_by(F.struct("doc_id", "doc", "title"), "doc_id").alias("l"))
        lines = first.select("headline_hash", "l.*").join(emb, F.col("doc") == emb.vec_id)
    room = SEQ_LEN - 2
    lines = lines.withColumn("words", word_tokens(ustrip("title")))
    n = F.greatest(F.ceil(F.size("words") / room).cast("int"), F.lit(1))
    lines = lines.withColumn("window", F.explode(F.sequence(F.lit(0), n - 1)))
    toks, length = wordpiece_frame(F.slice("words", F.col("window") * room + 1, F.lit(room)), SEQ_LEN)
    return lines.select("doc_id", "window", "headline_hash",
                        F.slice(e, 1, N_LOGITS).alias("logits"),
                        toks.alias("tokens"), heads.alias("attention"),
                        length.alias("length"))


def label_of_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id -> class id (0 negative, 1 neutral, 2 positive)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.when(F.col("toxic") == 1, 0)
                      .when(F.col("quality") == 1, 2).otherwise(1).alias("label"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase-corpus lines ``sentence@label`` built from labelled headlines.

    Every labelled document gives one line per line of its text.  With
    ``k = doc_id + line``, every 7th loses its ``@label`` (malformed line),
    every 11th gets an unknown label, every 13th label is upper-cased and
    space-padded, and every 17th sentence holds a carriage return and a NEL.
    Columns: line_no (line id), value.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = label_of_doc(spark, sf_dir)
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    name = F.get(names, F.col("label"))
    k = F.col("doc") + F.col("pos")
    name = (F.when(k % 11 == 0, F.lit("mixed"))
            .when(k % 13 == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" ")))
            .otherwise(name))
    title = F.when(k % 17 == 0, F.concat(F.lit("a\r\u0085"), F.col("title"))).otherwise(F.col("title"))
    line = F.when(k % 7 == 0, title).otherwise(F.concat(title, F.lit("@"), name))
    return (with_lines(docs.join(lab, "doc_id"))
            .select(F.col("doc_id").alias("line_no"), line.alias("value")))


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ledger rows from events: one run per event.

    job_name by ``pmod(user_id, 3)``; an 'error' event is a failed run
    (inserted = skipped = 0, error text); otherwise inserted = truncated
    value and skipped = ``k`` from props.  Columns: run_id, job_name,
    ran_at_ts, inserted, skipped, error."""
    ev = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(n) for n in JOB_NAMES])
    failed = F.col("event_type") == "error"
    k = F.regexp_extract(F.col("props"), r'"k":\s*(\d+)', 1)
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.get(names, F.pmod(F.col("user_id"), F.lit(len(JOB_NAMES))).cast("int")).alias("job_name"),
        F.col("ts").alias("ran_at_ts"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(
            F.col("value").try_cast("bigint")).alias("inserted"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(
            F.nullif(k, F.lit("")).try_cast("bigint")).alias("skipped"),
        F.when(failed, F.concat(F.lit("error: "), F.col("props"))).alias("error"))
