"""Target-distribution importance resampling by bit-sliced aggregation.

Every run of 1 to ``ngram`` words of a text is a feature, hashed into one of
``buckets`` buckets.  The corpus counts and the target's counts give every
bucket a signed integer gain (its log ratio in thousandths).

1. One pass over the texts keeps each text's distinct buckets and their counts;
   text is not read again.  Corpus and target counts are added up inside the
   tasks first, so at most ``buckets`` rows leave a task.
2. The counts of a text become bit planes of ``buckets`` bits: bit b of plane k
   is bit k of the count of bucket b.  The gains become bit planes as well (two's
   complement, the last plane negative).  The popcount of (count plane k AND gain
   plane j) times 2^(k+j), summed, is the exact sum of gains times counts.
3. The weight (floored mean gain) plus Gumbel noise from the id is the score.
   The scores are integers, so their histogram is bounded by their range; it
   gives the lowest score that can be drawn.  Only rows from there on are range
   partitioned and sorted; a row's rank is its place in its partition plus the
   rows of the partitions before it.  No step holds all rows in one task.

Defined results: a NULL or empty text has no words, no features and weight 0;
rows that repeat an id have the same noise, are counted and drawn one by one;
a NULL id is hashed as empty text and comes last among ties; rows equal in
score and id are ranked in the order of their counts; a very long text is one
row of at most ``buckets`` counts; an empty table gives an empty table and an
empty target leaves T = 0; the text column is dropped, other columns are
carried through (one named like a result column is replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, stored, table

# --- fixed values -----------------------------------------------------------
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
SLICE_DOCS = 1024             # texts whose planes are held at once
SCALE = 1000                  # gains and noise are thousandths
# ---------------------------------------------------------------------------

_FOLD = bytes(b if b in WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def text_buckets(text: bytes | None, buckets: int, ngram: int) -> tuple[int, np.ndarray]:
    """Number of words of a text and the bucket of every feature."""
    ws = text.translate(_FOLD).split() if text else []
    runs = list(map(crc32, ws))
    for n in range(2, ngram + 1):
        runs += [crc32(b" ".join(ws[i:i + n])) for i in range(len(ws) - n + 1)]
    return len(ws), np.array(runs, np.int64) % buckets


def _sketched(text: Column, buckets: int, ngram: int) -> Column:
    """n_words, n_features, distinct buckets (u4) and their counts (u4)."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for t in s:
                n, at = text_buckets(t, buckets, ngram)
                u, c = np.unique(at, return_counts=True)
                out.append((n, len(at), u.astype("<u4").tobytes(), c.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "at", "n"])
    return F.pandas_udf(run, "n_words bigint, n_features bigint, at binary, n binary")(text)


def _totals(sketches: DataFrame, buckets: int) -> dict[int, int]:
    """Occurrences of every bucket; at most ``buckets`` rows leave a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4")
            np.add.at(total, at, np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4"))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["b", "s"])
    rows = sketches.mapInArrow(run, "b bigint, s bigint").groupBy("b").agg(F.sum("s").alias("s"))
    return {r["b"]: r["s"] for r in rows.collect()}      # at most ``buckets`` rows


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(SCALE * math.log(
        (target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(buckets)],
        np.int64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bit planes of signed gains and the weight of each plane."""
    width = int(max(abs(int(gains.min())), abs(int(gains.max())), 1)).bit_length() + 1
    out = []
    for j in range(width):
        bits = np.zeros(-(-len(gains) // 64) * 64, np.uint8)
        bits[:len(gains)] = (gains >> j) & 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        out.append((-(1 << j) if j == width - 1 else 1 << j, words))
    return out


def sliced_sums(doc: np.ndarray, at: np.ndarray, n: np.ndarray, docs: int,
                planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of count times gain of every text; (doc, at) ascending and distinct."""
    total, words = np.zeros(docs, np.int64), len(planes[0][1])
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        on = (n >> k) & 1 == 1
        rows, row = np.unique(doc[on], return_inverse=True)
        cell = row * words + (at[on] >> 6)
        bit = np.left_shift(np.uint64(1), (at[on] & 63).astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
        counts = np.zeros(len(rows) * words, np.uint64)
        if len(cell):
            counts[cell[first]] = np.bitwise_or.reduceat(bit, first)
        counts = counts.reshape(len(rows), words)
        for worth, gain in planes:
            ones = np.bitwise_count(counts & gain).sum(axis=1, dtype=np.int64)
            total[rows] += (ones << k) * worth
    return total


def _weighed(sketch: Column, planes: list[tuple[int, np.ndarray]]) -> Column:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for d in parts:
            out = np.zeros(len(d), np.int64)
            for lo in range(0, len(d), SLICE_DOCS):
                some = d.iloc[lo:lo + SLICE_DOCS]
                size = np.array([len(x) // 4 for x in some["at"]], np.int64)
                sums = sliced_sums(np.repeat(np.arange(len(some)), size),
                                   np.frombuffer(b"".join(some["at"]), "<u4").astype(np.int64),
                                   np.frombuffer(b"".join(some["n"]), "<u4").astype(np.int64),
                                   len(some), planes)
                out[lo:lo + len(some)] = sums // np.maximum(some["n_features"].to_numpy(), 1)
            yield pd.Series(out)
    return F.pandas_udf(run, "bigint")(sketch)


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed:id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("bigint")


def _ranked(rows: DataFrame, order: list[Column], rank_col: str) -> DataFrame:
    """``rows`` with their place in ``order``: sorted ranges, each with the
    number of rows in the ranges before it."""
    k_at, k_part, k_off = hidden(rows, "at", "part", "off")
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(cut.withColumn(k_at, F.monotonically_increasing_id()), "ranges")
    cut = cut.withColumn(k_part, F.shiftright(k_at, 33))
    sizes = cut.groupBy(k_part).count().collect()        # one row per partition
    off, before = [], 0
    for part, n in sorted((r[0], r[1]) for r in sizes):
        off.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(off, f"`{k_part}` bigint, `{k_off}` bigint")
    place = F.col(k_off) + F.col(k_at).bitwiseAND((1 << 33) - 1) + 1
    return cut.join(F.broadcast(offsets), k_part).withColumn(rank_col, place).drop(k_at, k_part, k_off)


def importance_resample(df: DataFrame, target: DataFrame, *, id_col: str = "doc_id",
                        text_col: str = "text", target_col: str = "text", buckets: int = 10_000,
                        ngram: int = 1, min_words: int = 20, percent: int = 10,
                        seed: int = 2024) -> DataFrame:
    """``df`` without its text, with n_words, n_features, weight, score and
    rank: 1, 2, ... for the ``percent`` of the rows with at least ``min_words``
    words that score highest, NULL for the others."""
    results = ("n_words", "n_features", "weight", "score", "rank")
    keep = [F.col(f"`{c}`") for c in df.columns
            if c == id_col or c not in (text_col, *results)]
    k_sketch, = hidden(df, "sketch")

    def sketched(d: DataFrame, col: str, *cols: Column) -> DataFrame:
        return d.select(*cols, _sketched(F.col(f"`{col}`").cast("string").cast("binary"), buckets,
                                         ngram).alias(k_sketch))

    docs = stored(sketched(df, text_col, *keep), "sketches")
    fields = [F.col(k_sketch)["at"].alias("at"), F.col(k_sketch)["n"].alias("n")]
    gains = bucket_gains(_totals(docs.select(*fields), buckets),
                         _totals(sketched(target, target_col).select(*fields), buckets), buckets)
    weight = _weighed(F.struct(*fields, F.col(k_sketch)["n_features"].alias("n_features")),
                      gain_planes(gains))
    scored = docs.withColumns({"n_words": F.col(k_sketch)["n_words"],
                               "n_features": F.col(k_sketch)["n_features"], "weight": weight})
    scored = scored.drop(k_sketch).withColumn("score", F.col("weight") + gumbel(F.col(f"`{id_col}`"), seed))
    scored = stored(scored, "scores")

    # scores are integers of a bounded range, so this is a bounded histogram
    hist = scored.filter(F.col("n_words") >= min_words).groupBy("score").count().collect()
    draw = percent * sum(r[1] for r in hist) // 100
    least, above = None, 0
    for score, n in sorted(((r[0], r[1]) for r in hist), reverse=True):
        if above >= draw:
            break
        least, above = score, above + n
    may = F.lit(False) if least is None else (F.col("n_words") >= min_words) & (F.col("score") >= least)
    top = _ranked(scored.filter(may), [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last(),
                                       F.col("n_features").asc()], "rank")
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return top.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("bigint")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance_resample(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH step AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS crc
  FROM range(256) r(i)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS (SELECT r, unnest(w) AS w FROM doc),
known AS (SELECT DISTINCT w FROM (SELECT w FROM word UNION ALL SELECT w FROM item) x),
hashed AS (
  SELECT w, xor(list_reduce(
    list_transform(range(CAST(octet_length(encode(w)) AS BIGINT)),
                   lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)]),
    CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
  FROM known CROSS JOIN step),
s AS (SELECT b, count(*) AS s FROM word JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM item JOIN hashed USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM word) AS s_all, (SELECT count(*) FROM item) AS t_all),
gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (s_all + 10000)
                       / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b) CROSS JOIN n),
total AS (SELECT r, sum(g) AS g FROM word JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT doc.r, doc_id, len(w) AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(CAST(g AS DOUBLE) / len(w)) AS BIGINT) END AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM doc LEFT JOIN total USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS k,
         count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
       CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (r)"""
