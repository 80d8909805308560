"""DuckDB oracle SQL for the registered queries.

Tables ``events documents pages labels embeddings ...`` are views over the
same parquet files.  Column names match the Spark outputs exactly; DOUBLE
outputs are rounded to 6 digits like the Spark side.
"""

from __future__ import annotations

from . import sqlparts as S

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


oracle("session_date", f"""
SELECT event_id, {S.session_date('ts')} AS market_date FROM events""")

oracle("market_hours", S.with_ctes(S.TICKS) + f"""
SELECT ticker, count(*) AS n_ticks,
       count(*) FILTER (WHERE isodow({S.ny_local('ts')}) <= 5
         AND hour({S.ny_local('ts')}) * 3600 + minute({S.ny_local('ts')}) * 60
             + second({S.ny_local('ts')}) >= 34200
         AND hour({S.ny_local('ts')}) * 3600 + minute({S.ny_local('ts')}) * 60
             + second({S.ny_local('ts')}) < 57600) AS n_in_hours
FROM ticks GROUP BY ticker""")

oracle("ohlcv_bars", S.with_ctes(S.TICKS, S.BARS) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume FROM bars""")

oracle("log_return", S.with_ctes(S.TICKS, S.BARS, S.RETURNS) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume,
       {S.r6('daily_return')} AS daily_return FROM rets""")


# ------------------------------------------------------------ sources ----
from ..operators.epochs import Plan  # noqa: E402
from . import common as C  # noqa: E402


def _topics_cte() -> str:
    tk = S.values_list([(t, i) for i, t in enumerate(C.TICKERS)], ["ticker", "ticker_pos"])
    qm = S.values_list(list(C.TOPIC_QUERIES.items()), ["ticker", "query"])
    return f"""topics AS (
  SELECT t.ticker, CAST(t.ticker_pos AS INTEGER) AS ticker_pos,
         coalesce(q.query, t.ticker) AS query
  FROM {tk.replace(' AS v(', ' AS t(')} LEFT JOIN {qm.replace(' AS v(', ' AS q(')}
  ON q.ticker = t.ticker)"""


TERMS = f"""terms AS (
  SELECT ticker, ticker_pos, term, count(*) OVER (PARTITION BY ticker) AS n_terms
  FROM (SELECT DISTINCT ticker, ticker_pos, unnest({S.tokens('query')}) AS term FROM topics) x)"""

HITS = f"""doc_terms AS (
  SELECT DISTINCT doc_id, unnest({S.tokens('title')}) AS term FROM articles),
hits AS (
  SELECT d.doc_id, t.ticker, t.ticker_pos, t.n_terms, count(*) AS n_hit
  FROM doc_terms d JOIN terms t ON t.term = d.term
  GROUP BY d.doc_id, t.ticker, t.ticker_pos, t.n_terms)"""

oracle("articles_parse", S.with_ctes(S.ARTICLES) + """
SELECT ticker, batch_id, title, url, published_at, source_name FROM articles""")

oracle("feed_topk", S.with_ctes(S.ARTICLES) + f"""
SELECT ticker, feed_rank, rank, published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_ts DESC, feed_rank) AS rank
  FROM articles
  WHERE lang = 'en' AND CAST(published_ts AS DATE) >= DATE '{C.FEED_AS_OF}' - 7
    AND CAST(published_ts AS DATE) <= DATE '{C.FEED_AS_OF}') x
WHERE rank <= 20""")

oracle("topic_lookup", S.with_ctes(S.ARTICLES, _topics_cte()) + """
SELECT a.doc_id, a.ticker, coalesce(t.query, a.ticker) AS query
FROM articles a LEFT JOIN topics t ON t.ticker = a.ticker""")

oracle("feed_union", S.with_ctes(S.ARTICLES, _topics_cte(), TERMS, HITS) + """
SELECT doc_id, ticker, ticker_pos FROM hits""")

oracle("topic_match", S.with_ctes(S.ARTICLES, _topics_cte(), TERMS, HITS) + """
SELECT doc_id, ticker, ticker_pos, n_terms, n_hit FROM hits WHERE n_hit = n_terms""")

oracle("title_clean", S.with_ctes(S.ARTICLES, S.RECORDS) + """
SELECT feed_rank, ticker, headline FROM records""")

oracle("source_normalize", S.with_ctes(S.ARTICLES) + f"""
SELECT doc_id, {S.source_of('source_name', 'url')} AS source,
       {S.source_of('source_name', 'url', 'prefix')} AS source_prefix FROM articles""")

oracle("headline_hash", S.with_ctes(S.ARTICLES, S.RECORDS) + """
SELECT feed_rank, headline_hash FROM records""")

oracle("headline_dedup", S.with_ctes(S.ARTICLES, S.RECORDS, S.STORED) + f"""
SELECT headline_hash, ticker, headline, source, raw_timestamp, market_date, feed_rank,
       CASE WHEN batch_id < {C.cut_slot()} THEN 1 ELSE 2 END AS run
FROM stored""")

oracle("ingest_accounting", S.with_ctes(S.ARTICLES, S.RECORDS, S.STORED) + """
SELECT r.batch_id, coalesce(w.inserted, 0) AS inserted, r.n - coalesce(w.inserted, 0) AS skipped
FROM (SELECT batch_id, count(*) AS n FROM records GROUP BY batch_id) r
LEFT JOIN (SELECT batch_id, count(*) AS inserted FROM stored GROUP BY batch_id) w
  ON w.batch_id = r.batch_id""")

STORED_PRICES = [
    S.TICKS,
    f"ticks1 AS (SELECT * FROM ticks WHERE ts < TIMESTAMP '{C.PRICE_CUT}')",
    S.bars_cte("bars1", "ticks1"), S.rets_cte("rets1", "bars1"),
    S.bars_cte("bars2", "ticks"), S.rets_cte("rets2", "bars2"),
    """sprices AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, market_date ORDER BY fetch_ord) AS rn
    FROM (SELECT ticker, market_date, open, high, low, close, volume, daily_return,
                 1 AS fetch_ord FROM rets1
          UNION ALL
          SELECT ticker, market_date, open, high, low, close, volume, daily_return,
                 2 AS fetch_ord FROM rets2) u) x
  WHERE rn = 1)"""]

oracle("price_dedup", S.with_ctes(*STORED_PRICES) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume,
       {S.r6('daily_return')} AS daily_return, fetch_ord FROM sprices""")

oracle("price_window", S.with_ctes(S.TICKS, S.BARS, S.RETURNS) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume,
       {S.r6('daily_return')} AS daily_return FROM rets
WHERE market_date >= DATE '{C.PRICE_AS_OF}' - 14 AND market_date < DATE '{C.PRICE_AS_OF}' + 1""")

oracle("prices_unpivot", S.with_ctes(S.TICKS, S.BARS) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume FROM bars""")

oracle("safe_numeric", S.with_ctes(S.TICKS) + f"""
SELECT tick_id,
       {S.r6("CASE WHEN isnan(x) THEN NULL ELSE x END")} AS as_double,
       CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE CAST(trunc(x) AS BIGINT) END AS as_bigint
FROM (SELECT tick_id, CASE WHEN tick_id % 7 = 0 THEN CAST('NaN' AS DOUBLE)
                           ELSE price * CAST(10.0 AS DOUBLE) - CAST(1000.0 AS DOUBLE) END AS x
      FROM ticks) t""")

# ------------------------------------------------------------ scoring ----

SCORED = [S.ARTICLES, S.RECORDS, S.STORED, S.HUMAN_SCORES, S.LATEST_SCORES]

oracle("score_merge", S.with_ctes(*SCORED) + f"""
SELECT s.headline_hash, s.ticker, l.sentiment_label, {S.r6('l.confidence')} AS confidence,
       l.model_version
FROM stored s LEFT JOIN latest l ON l.headline_hash = s.headline_hash""")

oracle("unscored_backlog", S.with_ctes(*SCORED) + f"""
SELECT headline_hash, ticker, headline, batch_id, ticker_pos, feed_rank
FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM scores c WHERE c.headline_hash = s.headline_hash)
ORDER BY batch_id, ticker_pos, feed_rank LIMIT {C.BACKLOG_LIMIT}""")

# ------------------------------------------------------------- health ----

oracle("health_summary", S.with_ctes(*SCORED, *STORED_PRICES) + """
SELECT h.total_headlines, h.scored_headlines,
       h.total_headlines - h.scored_headlines AS unscored_headlines,
       p.total_price_records, h.last_news_timestamp, p.last_price_date
FROM (SELECT count(*) AS total_headlines, count(l.sentiment_label) AS scored_headlines,
             arg_max_null(s.raw_timestamp, (s.batch_id, s.ticker_pos, s.feed_rank))
               AS last_news_timestamp
      FROM stored s LEFT JOIN latest l ON l.headline_hash = s.headline_hash) h,
     (SELECT count(*) AS total_price_records,
             arg_max_null(market_date, (fetch_ord, ticker, market_date)) AS last_price_date
      FROM sprices) p""")

oracle("health_card", S.with_ctes(*SCORED, *STORED_PRICES) + """
SELECT format('{:,}', h.total_headlines) AS total_headlines,
       format('{:,}', h.scored_headlines) AS scored_headlines,
       format('{:,}', h.total_headlines - h.scored_headlines) AS unscored_headlines,
       format('{:,}', p.total_price_records) AS total_price_records,
       coalesce(h.last_news_timestamp, 'None') AS last_news_timestamp,
       coalesce(CAST(p.last_price_date AS VARCHAR), 'None') AS last_price_date
FROM (SELECT count(*) AS total_headlines, count(l.sentiment_label) AS scored_headlines,
             arg_max_null(s.raw_timestamp, (s.batch_id, s.ticker_pos, s.feed_rank))
               AS last_news_timestamp
      FROM stored s LEFT JOIN latest l ON l.headline_hash = s.headline_hash) h,
     (SELECT count(*) AS total_price_records,
             arg_max_null(market_date, (fetch_ord, ticker, market_date)) AS last_price_date
      FROM sprices) p""")

oracle("recent_headlines", S.with_ctes(S.ARTICLES, S.RECORDS, S.STORED) + """
SELECT ticker, market_date, headline, source FROM stored
ORDER BY batch_id DESC, ticker_pos DESC, feed_rank DESC LIMIT 10""")

JOBS = f"""jobs AS (
  SELECT event_id AS run_id,
         ['news_job', 'price_job', 'scoring_job'][((user_id % 3) + 3) % 3 + 1] AS job_name,
         {S.iso_z('ts')} AS ran_at,
         CASE WHEN event_type = 'error' THEN 0 ELSE TRY_CAST(trunc(value) AS BIGINT) END
           AS inserted,
         CASE WHEN event_type = 'error' THEN 0
              ELSE TRY_CAST(NULLIF(regexp_extract(props, '"k":\\s*(\\d+)', 1), '') AS BIGINT) END
           AS skipped,
         CASE WHEN event_type = 'error' THEN 'error: ' || props END AS error
  FROM events)"""

oracle("job_log_append", S.with_ctes(JOBS) + """
SELECT run_id, job_name, ran_at, inserted, skipped, error FROM jobs""")

oracle("recent_jobs", S.with_ctes(JOBS) + """
SELECT job_name, ran_at, inserted, skipped, error FROM jobs ORDER BY run_id DESC LIMIT 10""")

# ---------------------------------------------------------- analytics ----

DAILY_CTES = [*SCORED, S.DAILY]
JOINED = [S.TICKS, S.BARS, S.RETURNS, """nrets AS (
  SELECT *, lead(daily_return) OVER (PARTITION BY ticker ORDER BY market_date) AS next_return
  FROM rets)""", """joined AS (
  SELECT d.*, r.close, r.daily_return, r.next_return
  FROM daily d JOIN nrets r ON r.ticker = d.ticker AND r.market_date = d.market_date)"""]

oracle("daily_sentiment", S.with_ctes(*DAILY_CTES) + f"""
SELECT ticker, market_date, {S.r6('mean_sentiment')} AS mean_sentiment,
       {S.r6('weighted_sentiment')} AS weighted_sentiment, n_headlines FROM daily""")

oracle("sentiment_price_join", S.with_ctes(*DAILY_CTES, *JOINED) + f"""
SELECT ticker, market_date, {S.r6('mean_sentiment')} AS mean_sentiment,
       {S.r6('weighted_sentiment')} AS weighted_sentiment, n_headlines,
       {S.r6('close')} AS close, {S.r6('daily_return')} AS daily_return,
       {S.r6('next_return')} AS next_return FROM joined""")

oracle("bucketed_join", ORACLE["sentiment_price_join"])

oracle("rolling_pearson", S.with_ctes(*DAILY_CTES, *JOINED) + f"""
SELECT ticker, market_date, {S.r6('mean_sentiment')} AS mean_sentiment,
       {S.r6('next_return')} AS next_return, n_pairs,
       {S.r6('CASE WHEN n_pairs >= ' + str(C.ROLL_WINDOW) + ' AND sx * sy > 0 THEN cv / (sx * sy) END')}
         AS pearson
FROM (SELECT *, count(xm) OVER w AS n_pairs, covar_pop(xm, ym) OVER w AS cv,
             stddev_pop(xm) OVER w AS sx, stddev_pop(ym) OVER w AS sy
      FROM (SELECT *, CASE WHEN mean_sentiment IS NOT NULL AND next_return IS NOT NULL
                           THEN mean_sentiment END AS xm,
                      CASE WHEN mean_sentiment IS NOT NULL AND next_return IS NOT NULL
                           THEN next_return END AS ym FROM joined) m
      WINDOW w AS (PARTITION BY ticker ORDER BY market_date
                   ROWS BETWEEN {C.ROLL_WINDOW - 1} PRECEDING AND CURRENT ROW)) x""")

_HZ = ", ".join(f"({h})" for h in (0, *C.HORIZONS))
oracle("event_study", S.with_ctes(*DAILY_CTES, S.TICKS, f"""first_seen AS (
  SELECT ticker, market_date, min(published_ts) AS t0 FROM stored
  WHERE published_ts IS NOT NULL GROUP BY ticker, market_date)""", f"""hist AS (
  SELECT ticker, market_date, mean_sentiment,
         count(mean_sentiment) OVER w AS n_hist, avg(mean_sentiment) OVER w AS m,
         stddev_samp(mean_sentiment) OVER w AS sd
  FROM daily
  WINDOW w AS (PARTITION BY ticker ORDER BY market_date
               ROWS BETWEEN {C.SPIKE_LOOKBACK} PRECEDING AND 1 PRECEDING))""", f"""spikes AS (
  SELECT h.ticker, h.market_date, (h.mean_sentiment - h.m) / h.sd AS z, f.t0
  FROM hist h JOIN first_seen f ON f.ticker = h.ticker AND f.market_date = h.market_date
  WHERE h.n_hist >= {C.SPIKE_MIN_HISTORY} AND h.sd > 0
    AND abs((h.mean_sentiment - h.m) / h.sd) >= {C.SPIKE_K})""", f"""probes AS (
  SELECT ticker, market_date, CAST(sign(z) AS INTEGER) AS direction, hz.h AS horizon_hours,
         t0 + hz.h * INTERVAL 1 HOUR AS pt
  FROM spikes, (VALUES {_HZ}) hz(h))""", """hit AS (
  SELECT p.ticker, p.market_date, p.direction, p.horizon_hours,
         arg_min(t.price, (t.ts, t.tick_id)) AS v
  FROM probes p LEFT JOIN ticks t ON t.ticker = p.ticker AND t.ts >= p.pt
  GROUP BY p.ticker, p.market_date, p.direction, p.horizon_hours)""", """rets_h AS (
  SELECT h.horizon_hours, h.direction,
         CASE WHEN b.v > 0 AND h.v > 0 THEN ln(h.v / b.v) END AS ret
  FROM hit h JOIN hit b ON b.ticker = h.ticker AND b.market_date = h.market_date
                       AND b.horizon_hours = 0
  WHERE h.horizon_hours > 0)""") + f"""
SELECT horizon_hours, direction, count(ret) AS n_events, {S.r6('avg(ret)')} AS mean_return,
       {S.r6('stddev_samp(ret)')} AS std_return, {S.r6('min(ret)')} AS min_return,
       {S.r6('max(ret)')} AS max_return
FROM rets_h GROUP BY horizon_hours, direction""")


# ------------------------------------------------------------- corpus ----

_NAMES = "['negative', 'neutral', 'positive']"
LINES = f"""lines AS (
  SELECT doc_id AS line_no,
         CASE WHEN k % 7 = 0 THEN t
              ELSE t || '@' || CASE WHEN k % 11 = 0 THEN 'mixed'
                                    WHEN k % 13 = 0 THEN ' ' || upper({_NAMES}[label + 1]) || ' '
                                    ELSE {_NAMES}[label + 1] END END AS value
  FROM (SELECT doc_id, doc + pos AS k, label,
               CASE WHEN (doc + pos) % 17 = 0 THEN 'a' || chr(13) || chr(133) || title ELSE title END AS t
        FROM {S.lines_of("(SELECT d.doc_id AS doc, text, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id) j", "label")} y) x)"""

_SPLIT_RE = "(?s)^(.*)@([^@]*)$"
PARSED = f"""cls AS (
  SELECT line_no, {S.ustrip("coalesce(value, '')")} AS line FROM lines),
cls2 AS (
  SELECT line_no, line,
         {S.ustrip(f"CASE WHEN contains(line, '@') THEN regexp_extract(line, '{_SPLIT_RE}', 1) END")}
           AS sentence,
         CASE lower({S.ustrip(f"CASE WHEN contains(line, '@') THEN regexp_extract(line, '{_SPLIT_RE}', 2) END")})
           WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS label
  FROM cls),
parsed AS (
  SELECT line_no, sentence, label,
         CASE WHEN line = '' THEN 'blank' WHEN NOT contains(line, '@') THEN 'no_delimiter'
              WHEN label IS NULL THEN 'unknown_label' END AS reject
  FROM cls2),
kept AS (SELECT line_no, sentence, label FROM parsed WHERE reject IS NULL)"""


def _lr(src: str, n: str, draws: str, out: str) -> str:
    """Largest-remainder quota over a per-label table (twin of corpus._largest_remainder)."""
    return f"""SELECT * EXCLUDE (cont, fl, rem, need, rk),
       fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS {out}
FROM (SELECT *, {draws} - sum(fl) OVER () AS need,
             row_number() OVER (ORDER BY rem DESC, label) AS rk
      FROM (SELECT *, CAST(floor(cont) AS BIGINT) AS fl, cont - floor(cont) AS rem
            FROM (SELECT *, {draws} * {n} / sum({n}) OVER () AS cont FROM {src}) a) b) c"""


QUOTAS = f"""cnt AS (SELECT label, count(*) AS n FROM kept GROUP BY label),
c1 AS (SELECT *, sum(n) OVER () - CAST(ceil(CAST(0.30 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)
                 AS d1 FROM cnt),
q1 AS ({_lr('c1', 'n', 'd1', 'n_train')}),
c2 AS (SELECT *, n - n_train AS temp FROM q1),
c3 AS (SELECT *, sum(temp) OVER () - CAST(ceil(CAST(0.50 AS DOUBLE) * sum(temp) OVER ()) AS BIGINT)
                 AS d2 FROM c2),
q2 AS ({_lr('c3', 'temp', 'd2', 'n_validation')}),
quotas AS (SELECT label, n_train, n_validation, temp - n_validation AS n_test FROM q2),
split_counts AS (
  SELECT * FROM (
    SELECT 'train' AS split, label, n_train AS n FROM quotas
    UNION ALL SELECT 'validation', label, n_validation FROM quotas
    UNION ALL SELECT 'test', label, n_test FROM quotas) u
  WHERE n > 0)"""

oracle("corpus_parse", S.with_ctes(LINES, PARSED) + """
SELECT line_no, sentence, label FROM kept""")

oracle("corpus_audit", S.with_ctes(LINES, PARSED) + """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE reject = 'blank') AS n_blank,
       count(*) FILTER (WHERE reject = 'no_delimiter') AS n_no_delimiter,
       count(*) FILTER (WHERE reject = 'unknown_label') AS n_unknown_label,
       count(*) FILTER (WHERE reject IS NULL) AS n_rows
FROM parsed""")

oracle("class_distribution", S.with_ctes(LINES, PARSED) + f"""
SELECT label, ['Negative', 'Neutral', 'Positive'][label + 1] AS label_name, n,
       {S.r6('pct')} AS pct, repeat('█', CAST(floor(pct / 2) AS INTEGER)) AS bar
FROM (SELECT label, n, n / sum(n) OVER () * 100.0 AS pct
      FROM (SELECT label, count(*) AS n FROM kept GROUP BY label) c) x""")

oracle("stratified_split", S.with_ctes(LINES, PARSED, QUOTAS) + """
SELECT split, label, n FROM split_counts""")

oracle("split_roundtrip", S.with_ctes(LINES, PARSED, QUOTAS) + """
SELECT split, label, n FROM split_counts""")

oracle("split_ratios", S.with_ctes(LINES, PARSED, QUOTAS) + f"""
SELECT split,
       {S.r6('coalesce(sum(n) FILTER (WHERE label = 0), 0) / sum(n)')} AS negative,
       {S.r6('coalesce(sum(n) FILTER (WHERE label = 1), 0) / sum(n)')} AS neutral,
       {S.r6('coalesce(sum(n) FILTER (WHERE label = 2), 0) / sum(n)')} AS positive
FROM split_counts GROUP BY split""")

oracle("tokenize", S.with_ctes(LINES, PARSED) + f"""
SELECT line_no, label, list_slice({S.tokens('sentence')}, 1, 512) AS tokens FROM kept""")


# ------------------------------------------------------ epochs (M3, M4) ----
# softmax regression by mini-batches, written out step by step: weights are
# (bucket b, class c, w), bucket -1 is the bias

def _epochs_sql(plan) -> list[str]:
    num = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT)"
    ctes = [f"""toks AS (
  SELECT line_no, label, {S.tokens('sentence')} AS ts,
         {num.format("'split:' || line_no")} % 100 AS part, {num.format("'step:' || line_no")} % {plan.steps} AS step
  FROM kept)""", f"""feat AS MATERIALIZED (
  SELECT line_no, label, part, step, b, count(*) / max(n) AS v
  FROM (SELECT line_no, label, part, step, len(ts) AS n,
               {num.format("t")} % {plan.width} AS b
        FROM (SELECT *, unnest(ts) AS t FROM toks) x) y GROUP BY line_no, label, part, step, b
  UNION ALL SELECT line_no, label, part, step, -1, 1.0 FROM toks)""",
            "kinds AS (SELECT unnest(range(3)) AS c)",
            "w_0 AS (SELECT CAST(-1 AS BIGINT) AS b, c, CAST(0.0 AS DOUBLE) AS w FROM kinds)"]

    def probs(rows: str, w: str) -> str:
        return f"""(SELECT line_no, label, c, z, exp(z - max(z) OVER (PARTITION BY line_no))
                  / sum(exp(z - mz)) OVER (PARTITION BY line_no) AS p
           FROM (SELECT *, max(z) OVER (PARTITION BY line_no) AS mz
                 FROM (SELECT f.line_no, f.label, k.c, coalesce(sum(f.v * w.w), 0) AS z
                       FROM feat f CROSS JOIN kinds k LEFT JOIN {w} w ON w.b = f.b AND w.c = k.c
                       WHERE {rows} GROUP BY f.line_no, f.label, k.c) z0) z1)"""
    k = 0
    for epoch in range(plan.epochs):
        for step in range(plan.steps):
            rows = f"f.part < 70 AND f.step = {step}"
            ctes.append(f"""p_{k} AS MATERIALIZED {probs(rows, f'w_{k}')}""")
            ctes.append(f"""w_{k + 1} AS MATERIALIZED (
  SELECT b, c, sum(w) AS w FROM (
    SELECT b, c, w * (1 - CAST({plan.rate} AS DOUBLE) * {plan.decay}) AS w FROM w_{k}
    UNION ALL
    SELECT f.b, p.c, -CAST({plan.rate} AS DOUBLE) * sum(f.v * (p.p - CASE WHEN p.c = p.label THEN 1 ELSE 0 END))
             / (SELECT count(DISTINCT line_no) FROM p_{k})
    FROM feat f JOIN p_{k} p ON p.line_no = f.line_no GROUP BY f.b, p.c) u GROUP BY b, c)""")
            k += 1
        val = probs("f.part >= 70 AND f.part < 85", f"w_{k}")
        ctes.append(f"""e_{epoch} AS MATERIALIZED (SELECT {epoch} AS epoch, m.*,
    (SELECT -sum(ln(p)) / count(*) FROM ({' UNION ALL '.join(
        f'SELECT p FROM p_{j} WHERE c = label' for j in range(k - plan.steps, k))}) l) AS loss
  FROM {_metrics_sql(f"(SELECT line_no, label AS t, arg_max(c, (z, -c)) AS p FROM {val} v GROUP BY line_no, label)")} m)""")
    return ctes


def _metrics_sql(rows: str) -> str:
    """accuracy, precision, recall and f1 (macro) of rows(t, p)."""
    return f"""(WITH j AS {rows}, classes AS (SELECT t AS c FROM j UNION SELECT p FROM j),
   per AS (SELECT c.c, count(*) FILTER (WHERE j.t = c.c AND j.p = c.c) AS tp,
                  count(*) FILTER (WHERE j.t = c.c) AS tn, count(*) FILTER (WHERE j.p = c.c) AS pn
           FROM classes c, j GROUP BY c.c),
   pr AS (SELECT tp, tn, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS p,
                 CASE WHEN tn > 0 THEN tp / tn ELSE 0.0 END AS r FROM per)
  SELECT sum(tp) / sum(tn) AS accuracy, avg(p) AS precision, avg(r) AS recall,
         avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS f1 FROM pr)"""


_PLAN = Plan()
_EPOCHS = [LINES, PARSED, *_epochs_sql(_PLAN), "runs AS (" + " UNION ALL ".join(
    f"SELECT * FROM e_{e}" for e in range(_PLAN.epochs)) + ")"]
oracle("train_epochs", S.with_ctes(*_EPOCHS) + f"""
SELECT CAST(epoch AS INTEGER) AS epoch, {S.r6('loss')} AS loss, {S.r6('accuracy')} AS val_accuracy,
       {S.r6('precision')} AS val_precision, {S.r6('recall')} AS val_recall, {S.r6('f1')} AS val_f1,
       epoch = (SELECT arg_max(epoch, (f1, -epoch)) FROM runs) AS best
FROM runs""")


def _best_test() -> str:
    """Test metrics under the weights of every epoch, then the best one's."""
    out = []
    for e in range(_PLAN.epochs):
        w = f"w_{(e + 1) * _PLAN.steps}"
        rows = f"""(SELECT line_no, label AS t, arg_max(c, (z, -c)) AS p FROM (
          SELECT f.line_no, f.label, k.c, coalesce(sum(f.v * w.w), 0) AS z
          FROM feat f CROSS JOIN kinds k LEFT JOIN {w} w ON w.b = f.b AND w.c = k.c
          WHERE f.part >= 85 GROUP BY f.line_no, f.label, k.c) v GROUP BY line_no, label)"""
        out.append(f"SELECT {e} AS epoch, m.* FROM {_metrics_sql(rows)} m")
    return " UNION ALL ".join(out)


oracle("epoch_eval", S.with_ctes(*_EPOCHS) + f"""
SELECT {S.r6('accuracy')} AS accuracy, {S.r6('precision')} AS precision, {S.r6('recall')} AS recall,
       {S.r6('f1')} AS f1
FROM ({_best_test()}) t WHERE epoch = (SELECT arg_max(epoch, (f1, -epoch)) FROM runs)""")

_BEST = " UNION ALL ".join(
    f"SELECT * FROM w_{(e + 1) * _PLAN.steps} WHERE (SELECT arg_max(epoch, (f1, -epoch)) FROM runs) = {e}"
    for e in range(_PLAN.epochs))
oracle("epoch_drain", S.with_ctes(S.ARTICLES, S.RECORDS, S.STORED, S.HUMAN_SCORES, *_EPOCHS) + f"""
, best AS MATERIALIZED ({_BEST}),
backlog AS (
  SELECT headline_hash, {S.tokens('headline')} AS ts FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM scores c WHERE c.headline_hash = s.headline_hash)),
hf AS (
  SELECT headline_hash, b, count(*) / max(n) AS v
  FROM (SELECT headline_hash, len(ts) AS n,
               CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % {_PLAN.width} AS b
        FROM (SELECT *, unnest(ts) AS t FROM backlog) x) y GROUP BY headline_hash, b
  UNION ALL SELECT headline_hash, -1, 1.0 FROM backlog),
z AS (
  SELECT f.headline_hash, k.c, coalesce(sum(f.v * w.w), 0) AS z
  FROM hf f CROSS JOIN kinds k LEFT JOIN best w ON w.b = f.b AND w.c = k.c GROUP BY f.headline_hash, k.c)
SELECT headline_hash, {_NAMES}[arg_max(c, (z, -c)) + 1] AS sentiment_label,
       {S.r6('1 / sum(exp(z - mz))')} AS confidence
FROM (SELECT *, max(z) OVER (PARTITION BY headline_hash) AS mz FROM z) m GROUP BY headline_hash""")

oracle("corpus_files", S.with_ctes(LINES, PARSED) + """
SELECT sentence, label FROM kept""")

# ------------------------------------------------------- model decode ----

MODEL = f"""mo AS (
  SELECT doc_id, w AS "window", title, emb, logits,
         list_concat(['[CLS]'], ws[14 * w + 1:14 * w + 14], ['[SEP]']) AS toks
  FROM (SELECT *, unnest(range(greatest(CAST(ceil(len(ws) / 14) AS BIGINT), 1))) AS w
        FROM (SELECT doc_id, title, emb, list_slice(emb, 1, 3) AS logits,
                     {S.tokens(S.ustrip("coalesce(title, '')"))} AS ws
              FROM {S.lines_of("(SELECT e.vec_id AS doc, d.text, CAST(e.embedding AS DOUBLE[]) AS emb FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) j", "emb")} y) z) v),
cand AS (
  SELECT doc_id, "window", i, toks[i] AS tok,
         ((((0.0 + emb[i]) + emb[16 + i]) + emb[32 + i]) + emb[48 + i]) / 4 AS w
  FROM (SELECT *, unnest(range(2, len(toks))) AS i FROM mo) x)"""

LOGITS = """lg AS (SELECT vec_id AS doc_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 3) AS logits
                   FROM embeddings)"""


def _kw(stop_filter: str) -> str:
    return f"""
SELECT m.doc_id, m."window", k.keyword FROM mo m LEFT JOIN (
  SELECT doc_id, "window", regexp_replace(arg_max(tok, (w, -i)), '^#+', '') AS keyword
  FROM cand {stop_filter} GROUP BY doc_id, "window") k ON k.doc_id = m.doc_id AND k."window" = m."window\""""


oracle("logits_decode", S.with_ctes(LOGITS) + f"""
SELECT doc_id, pred, {_NAMES}[pred + 1] AS label, {S.r6('conf')} AS confidence
FROM (SELECT doc_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
             1.0 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS conf
      FROM lg) x""")

oracle("attention_keyword", S.with_ctes(MODEL) + _kw(""))


def _stop_sql() -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(C.STOP_WORDS)))
    return f"WHERE NOT list_contains([{words}], lower(regexp_replace(tok, '^#+', '')))"


oracle("keyword_stopwords", S.with_ctes(MODEL) + _kw(_stop_sql()))

oracle("macro_metrics", S.with_ctes(LOGITS) + f"""
, j AS (
  SELECT CAST(list_position(m.logits, list_max(m.logits)) - 1 AS INTEGER) AS p,
         CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS t
  FROM lg m JOIN labels l ON l.doc_id = m.doc_id),
classes AS (SELECT t AS c FROM j UNION SELECT p FROM j),
per AS (
  SELECT c.c,
         count(*) FILTER (WHERE j.t = c.c AND j.p = c.c) AS tp,
         count(*) FILTER (WHERE j.t = c.c) AS tn,
         count(*) FILTER (WHERE j.p = c.c) AS pn
  FROM classes c, j GROUP BY c.c),
pr AS (
  SELECT tp, tn, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS p,
         CASE WHEN tn > 0 THEN tp / tn ELSE 0.0 END AS r FROM per)
SELECT {S.r6('sum(tp) / sum(tn)')} AS accuracy, {S.r6('avg(p)')} AS precision,
       {S.r6('avg(r)')} AS recall,
       {S.r6('avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END)')} AS f1
FROM pr""")


# ---------------------------------------------------------- streaming ----

oracle("stream_headlines", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED) + """
SELECT headline_hash, ticker, headline, source, raw_timestamp, market_date FROM stored""")

oracle("stream_prices", S.with_ctes(*STORED_PRICES) + f"""
SELECT ticker, market_date, {S.r6('open')} AS open, {S.r6('high')} AS high,
       {S.r6('low')} AS low, {S.r6('close')} AS close, volume,
       {S.r6('daily_return')} AS daily_return, fetch_ord FROM sprices""")

# stream = batch: every stored headline is scored once; the scorer decodes
# the model outputs whose headline hash is stored (F11 label/confidence,
# F12 keyword)
oracle("stream_scoring", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED, MODEL) + f"""
, kw AS ({_kw("")}),
dec AS (
  SELECT x.doc_id, x."window", {S.sha("coalesce(x.title, '')")} AS headline_hash,
         {_NAMES}[x.pred + 1] AS sentiment_label, {S.r6('x.conf')} AS confidence
  FROM (SELECT doc_id, "window", title, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
               1.0 / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS conf
        FROM mo) x),
one AS (
  SELECT dec.*, kw.keyword, row_number() OVER (
           PARTITION BY headline_hash ORDER BY dec.doc_id, dec."window") AS rn
  FROM dec JOIN kw ON kw.doc_id = dec.doc_id AND kw."window" = dec."window")
SELECT headline_hash, sentiment_label, confidence, keyword AS attention_keyword
FROM one WHERE rn = 1 AND headline_hash IN (SELECT headline_hash FROM stored)""")

# ledger of the two availableNow runs of the headline stream (one micro-batch
# each, split on the poll-slot cut): a run inserts the stored hashes whose
# first arrival is in it and skips the rest of its records
_RUN = f"CASE WHEN batch_id < {C.cut_slot()} THEN 0 ELSE 1 END"
oracle("stream_ledger", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED) + f"""
, seen AS (
  SELECT {_RUN} AS batch_no, count(*) AS n, count(*) FILTER (WHERE {_RUN} = 1 AND published_ts < (
           SELECT max(published_ts) FROM records WHERE {_RUN} = 0) - INTERVAL 7 DAY) AS late
  FROM records GROUP BY 1),
won AS (SELECT {_RUN} AS batch_no, count(*) AS n FROM stored GROUP BY 1),
runs AS (SELECT * FROM (VALUES (0), (1)) v(batch_no))
SELECT 'news_job' AS job_name, CAST(coalesce(won.n, 0) AS BIGINT) AS inserted,
       CAST(coalesce(seen.n, 0) - coalesce(won.n, 0) AS BIGINT) AS skipped,
       CAST(coalesce(seen.late, 0) AS BIGINT) AS late, CAST(NULL AS VARCHAR) AS error, CAST(runs.batch_no AS BIGINT) AS batch_no
FROM runs LEFT JOIN seen USING (batch_no) LEFT JOIN won USING (batch_no)""")

# the same two halves landed the other way round: the older one is late where
# it is more than seven days behind the newest row of the half before it
_LATE = f"CASE WHEN batch_id < {C.cut_slot()} THEN 1 ELSE 0 END"
oracle("stream_late_rows", S.with_ctes(S.ARTICLES, S.RECORDS) + f"""
, rec AS (SELECT *, {_LATE} AS batch_no FROM records),
won AS (SELECT batch_no, count(*) AS n
        FROM (SELECT headline_hash, min(batch_no) AS batch_no FROM rec
              WHERE ticker IS NOT NULL AND source IS NOT NULL GROUP BY headline_hash) f GROUP BY batch_no),
seen AS (
  SELECT batch_no, count(*) AS n, max(published_ts) AS newest,
         count(*) FILTER (WHERE batch_no = 1 AND published_ts < (
           SELECT max(published_ts) FROM rec WHERE batch_no = 0) - INTERVAL 7 DAY) AS late
  FROM rec GROUP BY batch_no),
runs AS (SELECT * FROM (VALUES (0), (1)) v(batch_no))
SELECT CAST(coalesce(won.n, 0) AS BIGINT) AS inserted,
       CAST(coalesce(seen.n, 0) - coalesce(won.n, 0) AS BIGINT) AS skipped,
       CAST(coalesce(seen.late, 0) AS BIGINT) AS late, seen.newest, CAST(runs.batch_no AS BIGINT) AS batch_no
FROM runs LEFT JOIN seen USING (batch_no) LEFT JOIN won USING (batch_no)""")

# bounded look-up: the second run forgets what the first stored for sessions
# more than seven days before its own earliest one
oracle("stream_dedup_bounded", S.with_ctes(S.ARTICLES, S.RECORDS) + f"""
, rec AS (SELECT *, {_RUN} AS batch_no FROM records WHERE ticker IS NOT NULL AND source IS NOT NULL),
won AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY headline_hash, batch_no
             ORDER BY batch_id, ticker_pos, raw_timestamp DESC NULLS LAST, feed_rank) AS rn FROM rec) r
  WHERE rn = 1)
SELECT headline_hash, ticker, published_ts, market_date, CAST(batch_no AS BIGINT) AS batch_no
FROM won w
WHERE batch_no = 0 OR NOT EXISTS (
  SELECT 1 FROM won o WHERE o.batch_no = 0 AND o.headline_hash = w.headline_hash
    AND o.market_date >= (SELECT min(market_date) FROM rec WHERE batch_no = 1) - 7)""")

oracle("newest_stored", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED) + """
SELECT ticker, market_date, headline, source FROM stored
ORDER BY batch_id DESC, ticker_pos DESC, raw_timestamp ASC NULLS FIRST, feed_rank DESC LIMIT 10""")

oracle("stream_service", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED, S.TICKS, S.BARS, S.RETURNS) + """
SELECT 'news_job' AS job_name, (SELECT count(*) FROM stored) AS inserted,
       (SELECT count(*) FROM records) - (SELECT count(*) FROM stored) AS skipped, CAST(NULL AS BOOLEAN) AS broken
UNION ALL SELECT 'price_job', (SELECT count(*) FROM rets), 0, NULL
UNION ALL SELECT 'scoring_job', 0, 0, true FROM range(2)""")

# responses hold 20 articles of a (ticker, poll), newest first; every fifth
# response is broken
RESPONSES = f"""paged AS (
  SELECT *, ((page + ticker_pos + batch_id) % {C.DAMAGED_EVERY}) = 0 AS broken
  FROM (SELECT *, (row_number() OVER (PARTITION BY ticker, batch_id
                     ORDER BY published_at DESC NULLS LAST, feed_rank) - 1) // 20 AS page FROM articles) a)"""

oracle("feed_quarantine", S.with_ctes(S.ARTICLES, RESPONSES) + """
SELECT ticker, count(*) AS n_responses, count(*) FILTER (WHERE broken) AS n_broken,
       CAST(coalesce(sum(n) FILTER (WHERE NOT broken), 0) AS BIGINT) AS n_articles
FROM (SELECT ticker, batch_id, page, broken, count(*) AS n FROM paged GROUP BY ALL) r GROUP BY ticker""")

oracle("stream_quarantine", S.with_ctes(S.ARTICLES, RESPONSES) + f"""
, rec AS (
  SELECT ticker, source, {S.sha('headline')} AS headline_hash
  FROM (SELECT *, {S.clean_title('title')} AS headline, {S.source_of('source_name', 'url')} AS source
        FROM paged WHERE NOT broken) a
  WHERE {S.title_kept('headline')}),
n AS (SELECT count(*) AS n, count(DISTINCT headline_hash)
               FILTER (WHERE ticker IS NOT NULL AND source IS NOT NULL) AS won FROM rec)
SELECT CAST(0 AS BIGINT) AS batch_no, won AS inserted, n - won AS skipped,
       (SELECT count(*) FROM (SELECT DISTINCT ticker, batch_id, page FROM paged WHERE broken) b) AS n_broken
FROM n""")

oracle("health_stored", S.with_ctes(S.ARTICLES, S.RECORDS, S.PAGED, S.TICKS, S.BARS, S.RETURNS) + """
SELECT count(*) AS total_headlines, count(*) FILTER (WHERE headline_hash < '8') AS scored_headlines,
       count(*) FILTER (WHERE headline_hash >= '8') AS unscored_headlines, max(market_date) AS newest_session,
       (SELECT count(*) FROM rets) AS total_price_records,
       count(*) FILTER (WHERE headline_hash < '8') AS n_positive
FROM stored""")
