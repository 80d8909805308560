"""Line dedup by site-relative frequency (native).

Pages are grouped by host.  For every line with a word, the pages of the host
that hold it are divided by the pages of the host; lines above the boilerplate
ratio are dropped wherever they stand on that host.  Exact copies of a page on
one host count as one page (above and below the division), so a page does not
become boilerplate by being copied.

The line counts shuffle 8-byte hashes, pre-aggregated; texts are never
shuffled when the table of boilerplate lines is small enough to broadcast,
which the planner decides from its real (written) size.  A host has fewer
boilerplate lines than its mean lines per page divided by the ratio, so the
per-host list is bounded.

Defined results: lines are split at \\n and compared without the white space
around them; lines without a word are kept; a NULL host counts as the host ''
and a NULL text stays NULL (and is no page); a text that loses every line
becomes ''; repeated lines all go or all stay; repeated rows are one page; a
very long text is read whole; an empty table gives an empty table; extra
columns are carried through.  Lines of a host are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, hidden, stored, table

# --- fixed values -----------------------------------------------------------
MAX_RATIO = 0.2               # a line on more than this share of pages goes
MIN_PAGES = 5                 # ... if at least so many pages hold it
# ---------------------------------------------------------------------------


def host_of(url: Column | str) -> Column:
    """Lower-case host of a URL ('' if there is none)."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _core(line: Column) -> Column:
    return F.btrim(line, F.lit(GAP_CHARS))


def boilerplate_lines(df: DataFrame, site: Column, text_col: str = "text", *,
                      max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, line (hash), n_pages, site_pages of the lines to drop."""
    pages = df.filter(F.col(text_col).isNotNull()).select(
        F.coalesce(site, F.lit("")).alias("site"), F.col(text_col).alias("text"))
    pages = pages.select("site", F.xxhash64("text").alias("page"), "text")
    lines = F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: _core(x) != ""), lambda x: F.xxhash64(_core(x))))
    held = (pages.select("site", "page", F.explode(lines).alias("line"))
            .groupBy("site", "line", "page").agg(F.lit(1).alias("one"))
            .groupBy("site", "line").agg(F.count("*").alias("n_pages"))
            .filter(F.col("n_pages") >= min_pages))
    total = (pages.groupBy("site", "page").agg(F.lit(1).alias("one"))
             .groupBy("site").agg(F.count("*").alias("site_pages"))
             .filter(F.col("site_pages") >= min_pages))
    return held.join(total, "site").filter(F.col("n_pages") > max_ratio * F.col("site_pages"))


def drop_site_lines(df: DataFrame, site: Column, text_col: str = "text", *,
                    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                    dropped_col: str | None = None) -> DataFrame:
    """``df`` with boilerplate lines removed from ``text_col`` and, if named,
    their number in ``dropped_col``."""
    k_site, k_list, k_lines, k_hits = hidden(df, "site", "boiler", "lines", "hits")
    drop = boilerplate_lines(df, site, text_col, max_ratio=max_ratio, min_pages=min_pages)
    drop = stored(drop.groupBy(F.col("site").alias(k_site)).agg(
        F.collect_list("line").alias(k_list)), "boilerplate")
    columns = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, dropped_col)]
    own = df.withColumn(k_site, F.coalesce(site, F.lit("")))
    joined = own.join(drop, k_site, "left")
    text = F.col(f"`{text_col}`")
    joined = joined.withColumn(k_lines, F.when(F.col(k_list).isNotNull(), F.split(text, "\n")))
    joined = joined.withColumn(k_hits, F.array_intersect(
        F.transform(F.col(k_lines), lambda x: F.xxhash64(_core(x))), F.col(k_list)))
    kept = F.filter(F.col(k_lines), lambda x: (_core(x) == "") | ~F.array_contains(
        F.col(k_hits), F.xxhash64(_core(x))))
    hit = F.coalesce(F.size(k_hits) > 0, F.lit(False))
    joined = joined.withColumn(k_list, F.when(hit, kept))
    out = F.when(hit, F.array_join(F.col(k_list), "\n")).otherwise(text)
    extra = [] if dropped_col is None else [
        F.when(hit, F.size(k_lines) - F.size(k_list)).otherwise(0).cast("bigint").alias(dropped_col)]
    res = joined.select(*columns, out.alias(text_col), *extra)
    names = list(df.columns) + ([dropped_col] if dropped_col and dropped_col not in df.columns else [])
    return res.select(*[f"`{c}`" for c in names])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, ``source`` as the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_site_lines(docs, F.col("source"), dropped_col="n_dropped")
    return out.select("doc_id", "n_dropped", F.length("text").cast("bigint").alias("n_chars"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP10_SQL = """
WITH p AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls
           FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, site, text, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM p) x),
total AS (SELECT site, count(DISTINCT text) AS n FROM p GROUP BY site),
held AS (SELECT site, line, count(DISTINCT text) AS n FROM l WHERE line <> '' GROUP BY site, line),
boiler AS (SELECT h.site, h.line FROM held h JOIN total t ON t.site = h.site
           WHERE h.n >= 5 AND h.n > 0.2 * t.n),
kept AS (SELECT l.doc_id, count(b.line) AS n_dropped,
                string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL) AS text
         FROM l LEFT JOIN boiler b ON b.site = l.site AND b.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, '')) END AS n_chars,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
