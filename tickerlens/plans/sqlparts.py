"""SQL building blocks for the DuckDB oracle.

These are the SQL twins of ``sources.driver`` and of the scalar functions,
written independently in DuckDB's dialect (``lambda x:`` lambdas, ``isodow``,
``AT TIME ZONE``).  They are used only to build the oracle strings.
"""

from __future__ import annotations

# Unicode white space that a strip removes, as code points (its own list, so
# that a fault in the code under test shows)
_SPACE = (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
          0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE_SQL = " || ".join(f"chr({c})" for c in _SPACE)


def ticker(k: str) -> str:
    return f"printf('T%02d', ((({k}) % 20) + 20) % 20)"


def ticker_pos(k: str) -> str:
    return f"CAST(((({k}) % 20) + 20) % 20 AS INTEGER)"


def ustrip(x: str) -> str:
    return f"trim({x}, {_SPACE_SQL})"


def sha(x: str) -> str:
    return f"sha256({ustrip(x)})"


def lines_of(src: str, cols: str) -> str:
    """Lines of the texts of ``src(doc, text, <cols>)``: doc, pos (from 0),
    doc_id (line id), title."""
    extra = f", {cols}" if cols else ""
    return f"""(SELECT doc, pos, doc * 134217728 + pos AS doc_id, ls[pos + 1] AS title{extra}
   FROM (SELECT *, unnest(range(len(ls))) AS pos
         FROM (SELECT *, string_split(text, chr(10)) AS ls FROM {src}) s1) s2)"""


def ny_local(ts: str) -> str:
    return f"(({ts}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"


def session_date(ts: str) -> str:
    """F5 over a UTC timestamp expression."""
    local = ny_local(ts)
    base = f"(CAST({local} AS DATE) + CASE WHEN hour({local}) >= 16 THEN 1 ELSE 0 END)"
    wd = f"CAST(isodow({base}) - 1 AS INTEGER)"
    return f"CAST({base} + CASE WHEN {wd} >= 5 THEN 7 - {wd} ELSE 0 END AS DATE)"


def iso_z(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def poll_slot(ts: str) -> str:
    return (f"(CAST(datediff('day', DATE '1970-01-01', CAST({ts} AS DATE)) AS BIGINT) * 6"
            f" + CAST(floor(hour({ts}) / 4) AS BIGINT))")


def source_of(name: str, url: str, mode: str = "charset") -> str:
    n = f"coalesce({name}, '')"
    u = f"coalesce({url}, '')"
    after = f"substr({u}, strpos({u}, '//') + 2)"
    net = (f"(CASE WHEN regexp_matches({u}, '^([A-Za-z][-A-Za-z0-9+.]*:)?//') THEN "
           f"split_part(split_part(split_part({after}, '/', 1), '?', 1), '#', 1) ELSE '' END)")
    bad = f"(contains({net}, '[') <> contains({net}, ']'))"
    strip_re = "^[w.]+" if mode == "charset" else r"^www\."
    return (f"CASE WHEN {n} <> '' THEN replace(lower({n}), ' ', '-') "
            f"WHEN {u} <> '' AND NOT {bad} THEN regexp_replace({net}, '{strip_re}', '') "
            f"ELSE 'newsapi' END")


def clean_title(t: str) -> str:
    return ustrip(f"coalesce({t}, '')")


def title_kept(c: str) -> str:
    return f"({c} <> '' AND lower({c}) <> '[removed]')"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


# --- adapter CTEs (twins of sources.driver) ---------------------------------

TICKS = f"""ticks AS (
  SELECT {ticker('user_id')} AS ticker, ts, value AS price, event_id AS tick_id
  FROM events)"""

BARS = f"""bars AS (
  SELECT ticker, market_date,
         arg_min(price, (ts, tick_id)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
         count(*) AS volume
  FROM (SELECT *, {session_date('ts')} AS market_date FROM ticks) t
  GROUP BY ticker, market_date)"""

RETURNS = """rets AS (
  SELECT *, CASE WHEN prev_close > 0 AND close > 0 THEN ln(close / prev_close) END
           AS daily_return
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY market_date) AS prev_close
        FROM bars WHERE close IS NOT NULL AND NOT isnan(close)) b)"""

ARTICLES = f"""articles AS (
  SELECT l.doc_id, l.lang, {ticker('l.doc')} AS ticker, {ticker_pos('l.doc')} AS ticker_pos,
         l.title, CAST(NULL AS VARCHAR) AS source_name, p.url,
         {iso_z('e.ts')} AS published_at,
         coalesce({poll_slot('e.ts')}, 0) AS batch_id, l.doc_id AS feed_rank,
         date_trunc('second', e.ts) AS published_ts
  FROM {lines_of("(SELECT doc_id AS doc, lang, text FROM documents) d", "lang")} l
  LEFT JOIN events e ON e.event_id = l.doc * 5
  LEFT JOIN pages p ON p.page_id = l.doc)"""

RECORDS = f"""records AS (
  SELECT ticker, headline, {source_of('source_name', 'url')} AS source,
         published_at AS raw_timestamp,
         coalesce({session_date('published_ts')}, DATE '2024-02-01') AS market_date,
         published_ts, batch_id, ticker_pos, feed_rank, {sha('headline')} AS headline_hash
  FROM (SELECT *, {clean_title('title')} AS headline FROM articles) a
  WHERE {title_kept('headline')})"""

STORED = """stored AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY headline_hash
                                 ORDER BY batch_id, ticker_pos, feed_rank) AS rn
    FROM records
    WHERE ticker IS NOT NULL AND headline IS NOT NULL AND source IS NOT NULL) r
  WHERE rn = 1)"""

PAGED = """stored AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY headline_hash
                                 ORDER BY batch_id, ticker_pos, raw_timestamp DESC NULLS LAST, feed_rank) AS rn
    FROM records
    WHERE ticker IS NOT NULL AND headline IS NOT NULL AND source IS NOT NULL) r
  WHERE rn = 1)"""

HUMAN_SCORES = f"""scores AS (
  SELECT {sha("coalesce(title, '')")} AS headline_hash,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
              ELSE 'neutral' END AS sentiment_label,
         CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS attention_keyword,
         'labels' AS model_version, doc_id AS score_seq
  FROM {lines_of("(SELECT l.doc_id AS doc, text, toxic, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id) j", "toxic, quality")} x)"""

LATEST_SCORES = """latest AS (
  SELECT headline_hash, arg_max(sentiment_label, score_seq) AS sentiment_label,
         arg_max(confidence, score_seq) AS confidence,
         arg_max(model_version, score_seq) AS model_version
  FROM scores GROUP BY headline_hash)"""

DAILY = """daily AS (
  SELECT s.ticker, s.market_date,
         avg(CASE l.sentiment_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0
                                    WHEN 'positive' THEN 1 END) AS mean_sentiment,
         sum(CASE l.sentiment_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0
                                    WHEN 'positive' THEN 1 END * l.confidence)
           / sum(l.confidence) AS weighted_sentiment,
         count(*) AS n_headlines
  FROM stored s JOIN latest l ON l.headline_hash = s.headline_hash
  GROUP BY s.ticker, s.market_date)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def tokens(x: str) -> str:
    """Twin of ``functions.model.word_tokens``."""
    gaps = " || ".join(f"chr({c})" for c in range(9, 14))
    return (f"list_filter(string_split(translate(lower({x}), {gaps}, '     '), ' '), "
            f"lambda t: t <> '')")


def bars_cte(name: str, src: str) -> str:
    return f"""{name} AS (
  SELECT ticker, market_date,
         arg_min(price, (ts, tick_id)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
         count(*) AS volume
  FROM (SELECT *, {session_date('ts')} AS market_date FROM {src}) t
  GROUP BY ticker, market_date)"""


def rets_cte(name: str, bars: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN prev_close > 0 AND close > 0 THEN ln(close / prev_close) END
           AS daily_return
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY market_date) AS prev_close
        FROM {bars} WHERE close IS NOT NULL AND NOT isnan(close)) b)"""


def values_list(rows, names) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"
