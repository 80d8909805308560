"""Article feeds (S1-S4): landed JSON responses, request window, ticker
fan-out and the ticker -> search-query lookup.

A feed response is ``{"articles": [{title, url, publishedAt, source: {name}}]}``
with every field optional.  ``spark.read.schema(FEED_SCHEMA).json(path)``
reads landed files; ``parse_feed`` does the same for a column of JSON text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import word_tokens
from ..functions.time import days_from, parse_iso_utc

ARTICLE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
])
FEED_SCHEMA = T.StructType([T.StructField("articles", T.ArrayType(ARTICLE))])

# --- fixed values -----------------------------------------------------------
RAW_TIME = "published_raw"    # publish time before it became text, if known
BROKEN = "_broken"    # column of a response that is no JSON
PAGE_SIZE = 20        # articles per ticker per request
DAYS_BACK = 7         # request window
LANGUAGE = "en"
# ---------------------------------------------------------------------------
# feed_rank values per rank cell for articles without a publish time (our
# choice: bounds the rows one paging task ranks when times are missing)
NULL_TIME_BUCKET = 4096
# articles of a (ticker, batch_id) that one task ranks and cuts into pages (our
# choice); larger groups are ranked by cells
GROUP_ROWS = 50_000


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files -> one row per response (``articles`` array).

    Files are expected to carry the request context as top-level fields
    ``ticker``, ``ticker_pos`` and ``batch_id`` next to ``articles``."""
    schema = T.StructType(FEED_SCHEMA.fields + [
        T.StructField("ticker", T.StringType()),
        T.StructField("ticker_pos", T.IntegerType()),
        T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).json(path)


def parse_feed(responses: DataFrame, json_col: str = "value") -> DataFrame:
    """S1 for JSON text: parse with the fixed schema, keep context columns."""
    ctx = [c for c in responses.columns if c != json_col]
    return responses.select(*ctx, F.from_json(F.col(json_col), FEED_SCHEMA).alias("r")) \
        .select(*ctx, F.col("r.articles").alias("articles"))


def checked_feed(responses: DataFrame, json_col: str = "value") -> DataFrame:
    """S1 for JSON text that may be broken: like ``parse_feed``, with the text
    and the reason of a response that cannot be used (``empty`` or
    ``malformed``; NULL for a usable one).  A response without articles is
    usable and has none."""
    ctx = [c for c in responses.columns if c != json_col]
    checked = T.StructType([*FEED_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    text = F.col(json_col)
    parsed = responses.select(*ctx, text.alias("text"), F.from_json(
        text, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    reason = (F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty")
              .when(F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull(), "malformed"))
    return parsed.select(*ctx, "text", reason.alias("reason"),
                         F.when(reason.isNull(), F.col("r.articles")).alias("articles"))


def split_feed(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable responses, and the others with text and reason."""
    good = checked.filter(F.col("reason").isNull()).drop("text", "reason")
    return good, checked.filter(F.col("reason").isNotNull()).drop("articles")


def explode_articles(feeds: DataFrame) -> DataFrame:
    """One row per article; a missing ``articles`` array yields no rows.

    ``feed_rank`` is the position inside the response (1-based); the arrival
    order of an article is (batch_id, ticker_pos, page, feed_rank)."""
    ctx = [c for c in feeds.columns if c != "articles"]
    ex = feeds.select(*ctx, F.posexplode(F.coalesce(
        F.col("articles"), F.array().cast(T.ArrayType(ARTICLE)))).alias("pos", "a"))
    return ex.select(*ctx, (F.col("pos") + 1).alias("feed_pos"),
                     F.col("a.title").alias("title"), F.col("a.url").alias("url"),
                     F.col("a.publishedAt").alias("published_at"),
                     F.col("a.source.name").alias("source_name"))


def build_feed_pages(articles: DataFrame, page_size: int = PAGE_SIZE,
                     opened: Callable[[DataFrame], DataFrame] | None = None,
                     n_rows: Column | None = None) -> DataFrame:
    """Group article rows into JSON responses of at most ``page_size``
    articles per (ticker, batch_id), newest first, like a paged API.

    A row of ``articles`` may hold several articles of one group (a document):
    ``opened`` then makes article rows of such rows, which happens after they
    were brought to their group, and ``n_rows`` is how many it makes of a row, so
    that groups are measured without opening (or moving) what a row holds.

    A group of at most ``GROUP_ROWS`` articles is ranked and paged where one
    shuffle brings it together.  A larger one is ranked per (ticker, batch_id,
    minute) cell plus an offset, never as one window over a whole group.  A page
    holds at most ``page_size``, so ``collect_list`` never holds more."""
    from ..operators.rank import distributed_rank
    group = ["ticker", "batch_id"]
    # groups above the bound are at most articles / GROUP_ROWS rows
    n = F.count(F.lit(1)) if n_rows is None else F.sum(n_rows)
    large = (articles.groupBy(*group).agg(n.alias("n")).filter(F.col("n") > GROUP_ROWS)
             .select(*[F.col(c).alias(f"_l_{c}") for c in group]))
    is_large = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in group]
    order = [F.col("published_at").desc_nulls_last(), F.col("feed_rank")]
    small = articles.join(F.broadcast(large), is_large, "left_anti")
    cells = articles.join(F.broadcast(large), is_large, "left_semi")
    if opened:
        small, cells = opened(small.repartition(*group)), opened(cells)
    by_group = small.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    # rank newest first; cells = publish minute, so a hot (ticker, poll)
    # group is ranked by many tasks; the (group, minute) offset table grows
    # with the data and is left to the planner (not force-broadcast)
    # articles without a publish time sort last by feed_rank; they are cut
    # into feed_rank buckets so that they are not one cell either.  The cell
    # (minute, -bucket) in descending order is monotone with the sort order.
    minute = F.substring(F.col("published_at"), 1, 16)
    bucket = F.when(F.col("published_at").isNull(),
                    -F.floor(F.col("feed_rank") / F.lit(NULL_TIME_BUCKET)))
    by_cell = distributed_rank(
        cells, group, F.struct(minute.alias("m"), bucket.alias("b")), order, out="rk",
        cell_desc=True, broadcast_offsets=False)
    return _cut_pages(by_group, page_size).unionByName(_cut_pages(by_cell, page_size))


def _cut_pages(ranked: DataFrame, page_size: int) -> DataFrame:
    """Pages of ranked articles; grouped by more than the rank's groups, so rows
    that lie by group are not shuffled again."""
    item = F.struct(F.col("title"), F.col("url"), F.col("published_at").alias("publishedAt"),
                    F.struct(F.col("source_name").alias("name")).alias("source"))
    pages = (ranked.groupBy("ticker", "ticker_pos", "batch_id",
                            F.floor(F.col("rk") / page_size).alias("page"))
             .agg(F.sort_array(F.collect_list(F.struct(F.col("rk"), item.alias("a"))))
                  .alias("items")))
    return pages.select("ticker", "ticker_pos", "batch_id", "page",
                        F.to_json(F.struct(F.transform("items", lambda s: s["a"])
                                           .alias("articles"))).alias("value"))


def feed_window(articles: DataFrame, as_of, days: int = DAYS_BACK,
                k: int = PAGE_SIZE, lang: str | None = LANGUAGE) -> DataFrame:
    """What one request returns per ticker: language filter, published
    within ``[as_of - days, as_of]`` (whole days), newest ``k`` per ticker.

    ``row_number() <= k`` plans as a WindowGroupLimit, so each mapper keeps at
    most ``k`` rows per ticker before the shuffle."""
    ts = parse_iso_utc("published_at")
    # the raw time, where the source has one, is tested before it is formatted:
    # the filter then reaches the scan
    d = F.to_date(F.col(RAW_TIME) if RAW_TIME in articles.columns else ts)
    if RAW_TIME in articles.columns:
        lo, hi = (days_from(as_of, k).cast("timestamp_ntz") for k in (-days, 1))
        articles = articles.filter((F.col(RAW_TIME) >= lo) & (F.col(RAW_TIME) < hi))
    cond = (d >= days_from(as_of, -days)) & (d <= days_from(as_of, 0))
    if lang is not None and "lang" in articles.columns:
        cond = cond & (F.col("lang") == lang)
    w = Window.partitionBy("ticker").orderBy(ts.desc(), F.col("feed_rank"))
    return (articles.filter(cond)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def topic_table(spark: SparkSession, tickers: Sequence[str],
                queries: Mapping[str, str]) -> DataFrame:
    """Configured tickers with their search query (default: the ticker).

    Config-sized; safe to broadcast."""
    rows = [(t, i) for i, t in enumerate(tickers)]
    tk = spark.createDataFrame(rows, "ticker string, ticker_pos int")
    qm = spark.createDataFrame(list(queries.items()) or [("", "")],
                               "ticker string, query string")
    return (tk.join(F.broadcast(qm), "ticker", "left")
            .select("ticker", "ticker_pos",
                    F.coalesce(F.col("query"), F.col("ticker")).alias("query")))


def topic_terms(topics: DataFrame) -> DataFrame:
    """(ticker, ticker_pos, term, n_terms) from the query strings."""
    toks = F.array_distinct(word_tokens("query"))
    return topics.select("ticker", "ticker_pos", F.size(toks).alias("n_terms"),
                         F.explode(toks).alias("term"))


def topic_match(docs: DataFrame, topics: DataFrame, text: str = "headline",
                doc_key: Sequence[str] = ("doc_id",), mode: str = "any") -> DataFrame:
    """X5 (re-aimed remote search): which tickers' queries match a text.

    Distinct lower-case tokens of the text are equi-joined to the broadcast
    term table; a (doc, ticker) pair matches when at least one term (``any``)
    or every term (``all``) occurs.  Output: doc key, ticker, ticker_pos,
    n_terms, n_hit."""
    if mode not in ("any", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(doc_key)
    terms = topic_terms(topics)
    toks = docs.select(*keys, F.explode(F.array_distinct(word_tokens(text))).alias("term"))
    hits = (toks.join(F.broadcast(terms), "term")
            .groupBy(*keys, "ticker", "ticker_pos", "n_terms")
            .agg(F.count(F.lit(1)).alias("n_hit")))
    if mode == "all":
        hits = hits.filter(F.col("n_hit") == F.col("n_terms"))
    return hits


def fan_out(articles: DataFrame, topics: DataFrame, mode: str = "any") -> DataFrame:
    """Per-ticker search results appended in ticker order.

    Each article is returned once per ticker whose query it matches, with
    that ticker's position, so first-wins dedup keeps the earliest ticker."""
    m = topic_match(articles.select("doc_id", F.col("title").alias("t")), topics,
                    text="t", mode=mode).select("doc_id", "ticker", "ticker_pos")
    return articles.drop("ticker", "ticker_pos").join(m, "doc_id")


def feed_documents(pages: DataFrame) -> DataFrame:
    """Pages as landed documents: request context plus the parsed
    ``articles`` array, ready for ``write.json``."""
    return pages.select("ticker", "ticker_pos", "batch_id", "page",
                        F.from_json(F.col("value"), FEED_SCHEMA)["articles"].alias("articles"))


def land(spark: SparkSession, written: str, in_dir: str, name: str) -> None:
    """Move the finished files of ``written`` into a watched folder, each whole
    at once (a rename), as files of ``name``.  Nothing written means an empty
    response file: the poll took place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    src, dst = path(written), path(in_dir)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(dst)
    files = [s.getPath() for s in fs.listStatus(src)] if fs.exists(src) else []
    for f in files:
        if not f.getName().startswith(("_", ".")) and not fs.rename(f, path(dst, f"{name}-{f.getName()}")):
            raise RuntimeError(f"{f} could not be moved to {in_dir}")
    if not files:
        spark.createDataFrame([], FEED_SCHEMA).write.mode("append").json(in_dir)
