"""Quality rules as a short-circuit cascade (native).

Every rule rejects a text by comparing integer statistics of it.  A bounded
sample gives each rule's cost (its units of work, e.g. characters or 8-word
windows, times a weight) and its selectivity (share of the sample that it
rejects); the cascade tries the rules by rejections per cost.  A statistic
that only later rules need is computed only for texts still alive.  The order
changes the work, never the verdict: a text is kept when no rule rejects it.

Defined results: a NULL text counts as an empty text, an empty or blank text
has no words and fails ``too_short``; an empty table gives an empty table;
extra columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, hidden, words

# --- fixed values (rule parameters) -----------------------------------------
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8                    # words per repeat window
MIN_WORDS = 20
MAX_REPEAT_PCT = 30           # words inside repeated windows
MAX_SYMBOL_PCT = 10           # symbols per 100 words
MAX_BANG_PCT = 30             # exclamation marks per 100 words
MAX_DUP_LINE_PCT = 40         # repeated lines per 100 lines with a word
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 2, 25
SAMPLE_ROWS = 1000            # bound of the sample that sets the order
SAMPLE_FRACTION = 0.2
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the named statistics to a boolean Column."""
    name: str
    stats: tuple[str, ...]
    reject: Callable[[dict[str, Column]], Column]
    unit: str                 # "chars" or "words": what the work grows with
    weight: float             # work per unit, relative to one character scan


RULES = (
    Rule("too_short", ("n_words",), lambda s: s["n_words"] < MIN_WORDS, "chars", 1.0),
    Rule("symbols", ("n_symbols", "n_words"),
         lambda s: 100 * s["n_symbols"] > MAX_SYMBOL_PCT * s["n_words"], "chars", 2.0),
    Rule("shouting", ("n_bangs", "n_words"),
         lambda s: 100 * s["n_bangs"] > MAX_BANG_PCT * s["n_words"], "chars", 2.0),
    Rule("word_length", ("word_chars", "n_words"),
         lambda s: (s["word_chars"] < MIN_MEAN_CHARS * s["n_words"])
         | (s["word_chars"] > MAX_MEAN_CHARS * s["n_words"]), "chars", 2.0),
    Rule("dup_lines", ("n_dup_lines", "n_lines"),
         lambda s: 100 * s["n_dup_lines"] > MAX_DUP_LINE_PCT * s["n_lines"], "chars", 3.0),
    Rule("repeats", ("n_repeat_words", "n_words"),
         lambda s: 100 * s["n_repeat_words"] > MAX_REPEAT_PCT * s["n_words"], "words", 60.0),
)
BASE_RULES = ("too_short", "repeats")
BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pairwise(a: Column, step: int) -> Column:
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))


class _Stats:
    """Adds statistics to a frame as hidden columns, each at most once."""

    def __init__(self, df: DataFrame, text_col: str):
        self.names = hidden(df, "text", "words", "lines", "hashes", "sorted", "starts", "alive",
                            "h1", "h2", "h4", "n_words", "n_lines", "word_chars", "n_symbols", "n_bangs",
                            "n_dup_lines", "n_repeat_words")
        (self.text, self.words, self.lines, self.hashes, self.sorted, self.starts,
         self.alive, self.h1, self.h2, self.h4, *_) = self.names
        stat_names = ("n_words", "n_lines", "word_chars", "n_symbols", "n_bangs",
                      "n_dup_lines", "n_repeat_words")
        self.of = dict(zip(stat_names, self.names[10:], strict=True))
        self.done: set[str] = set()
        self.df = df.withColumn(self.text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def _add(self, name: str, expr: Column, guard: Column | None) -> None:
        if name not in self.done:
            self.done.add(name)
            self.df = self.df.withColumn(name, expr if guard is None else F.when(guard, expr))

    def col(self, stat: str) -> Column:
        return F.col(self.of[stat])

    def need(self, stat: str, guard: Column | None = None) -> None:
        text, c = F.col(self.text), self.of[stat]
        if c in self.done:
            return
        if stat in ("n_words", "word_chars", "n_repeat_words"):
            self._add(self.words, words(text), guard)
        if stat == "n_words":
            self._add(c, F.size(self.words).cast("bigint"), guard)
        elif stat == "word_chars":
            self._add(c, F.length(F.array_join(self.words, "")).cast("bigint"), guard)
        elif stat == "n_symbols":
            rest = F.regexp_replace(text, SYMBOLS, "")
            self._add(c, (F.length(text) - F.length(rest)).cast("bigint"), guard)
        elif stat == "n_bangs":
            rest = F.replace(text, F.lit("!"), F.lit(""))
            self._add(c, (F.length(text) - F.length(rest)).cast("bigint"), guard)
        elif stat in ("n_lines", "n_dup_lines"):
            self._add(self.lines, F.filter(F.split(text, "\n"),
                                           lambda x: F.btrim(x, F.lit(GAP_CHARS)) != ""), guard)
            n = F.size(self.lines)
            self._add(self.of["n_lines"], n.cast("bigint"), guard)
            self._add(self.of["n_dup_lines"],
                      (n - F.size(F.array_distinct(self.lines))).cast("bigint"), guard)
        elif stat == "n_repeat_words":
            self._repeat_words(c, guard)

    def _repeat_words(self, out: str, guard: Column | None) -> None:
        """Words in 8-word windows that occur twice or more in the text.

        Windows are compared by a 64-bit hash inside one text, built by
        doubling (1, 2, 4, 8 words); the sort that finds equal ones runs only
        for texts that have any."""
        h, s, st = (F.col(x) for x in (self.hashes, self.sorted, self.starts))
        self._add(self.h1, F.transform(self.words, lambda x: F.xxhash64(x)), guard)
        for half, src, to in ((1, self.h1, self.h2), (2, self.h2, self.h4), (4, self.h4, self.hashes)):
            self._add(to, _pairwise(F.col(src), half), guard)
        self.df = self.df.withColumn(self.hashes, F.slice(
            self.hashes, 1, F.greatest(F.size(self.words) - (WINDOW - 1), F.lit(0))))
        repeats = F.size(F.array_distinct(h)) < F.size(h)
        self._add(self.sorted, F.when(repeats, F.array_sort(F.transform(
            h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))), None)
        last = F.size(s) - 1

        def twice(e, k):
            before = F.get(s, k - 1)["h"] == e["h"]
            after = F.get(s, k + 1)["h"] == e["h"]
            return F.when(k > 0, before).otherwise(False) | F.when(k < last, after).otherwise(False)

        self._add(self.starts, F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"])), None)
        runs = F.transform(st, lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(st, k + 1) - x, F.lit(WINDOW))))
        covered = F.coalesce(F.aggregate(runs, F.lit(0), lambda a, x: a + x), F.lit(0))
        self._add(out, covered.cast("bigint"), guard)


def rule_order(df: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text",
               sample_rows: int = SAMPLE_ROWS, fraction: float = SAMPLE_FRACTION,
               seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, cost per text) by rejections per cost, best
    first; ties by name.  Reads at most ``sample_rows`` sampled texts."""
    spark = df.sparkSession
    rows = (df.select(F.col(text_col).cast("string").alias("text"))
            .sample(fraction=fraction, seed=seed).take(sample_rows))
    sample = spark.createDataFrame([(r["text"],) for r in rows], "text string")
    st = _Stats(sample, "text")
    for r in rules:
        for s in r.stats:
            st.need(s)
    st.need("n_words")
    vals = {s: st.col(s) for s in st.of if st.of[s] in st.done}
    got = st.df.agg(
        F.avg(F.length(st.text)).alias("chars"), F.avg(st.col("n_words")).alias("words"),
        *[F.avg(r.reject(vals).cast("int")).alias(f"r{k}") for k, r in enumerate(rules)]).first()
    units = {"chars": got["chars"] or 0.0, "words": got["words"] or 0.0}
    rated = [(r, got[f"r{k}"] or 0.0, max(r.weight * units[r.unit], 1.0))
             for k, r in enumerate(rules)]
    return sorted(rated, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def quality_cascade(df: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text",
                    order: Sequence[Rule] | None = None, with_stats: Sequence[str] = (),
                    kept_col: str = "kept", failed_col: str | None = None,
                    kept_only: bool = False) -> DataFrame:
    """``df`` (with ``kept_only`` its kept rows) plus ``kept_col`` (no rule rejects) and, if named, the first
    rule of the cascade that rejects (NULL when kept) and the statistics of
    ``with_stats`` for every row (else they are computed only while alive)."""
    if order is None:
        order = [r for r, _, _ in rule_order(df, rules, text_col=text_col)]
    columns = list(df.columns)
    st = _Stats(df, text_col)
    for s in with_stats:
        st.need(s)
    alive = F.col(st.alive).isNull()
    st.df = st.df.withColumn(st.alive, F.lit(None).cast("string"))
    for r in order:
        for s in r.stats:
            st.need(s, alive)
        vals = {s: st.col(s) for s in r.stats}
        st.df = st.df.withColumn(st.alive, F.when(~alive, F.col(st.alive)).when(
            r.reject(vals), F.lit(r.name)))
    out = [F.col(f"`{c}`") for c in columns if c not in {kept_col, failed_col, *with_stats}]
    out += [st.col(s).alias(s) for s in with_stats]
    out.append(alive.alias(kept_col))
    if failed_col:
        out.append(F.col(st.alive).alias(failed_col))
    if not kept_only:
        return st.df.select(*out)
    # a row number beside the verdict keeps the optimizer from copying the
    # statistics' expressions into the filter again and again
    row, = hidden(st.df, "row")
    judged = st.df.withColumn(row, F.monotonically_increasing_id())
    return judged.filter(alive & (F.col(row) >= 0)).select(*out)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_cascade(docs, with_stats=BASE_STATS)
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return judged.select("doc_id", *BASE_STATS, base.alias("base_failed"), "kept")


OP8_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8) x),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) x
  WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) x
  GROUP BY doc_id),
s AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
v AS (
  SELECT *, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR 100 * n_symbols > 10 * n_words OR 100 * n_bangs > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM v"""
