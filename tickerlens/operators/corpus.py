"""Labelled phrase corpus: parse (S6, F9, P6, P7), audit (A3), exact
stratified split (W4, U3), per-split class ratios (A4) and split sink (S7).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABELS, label_id, pct_bar, split_last, ustrip
from .rank import distributed_rank

SPLITS = ("train", "validation", "test")


def read_corpus(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """One row per ``\\n``-separated line, decoded from ``encoding``.

    The text source keeps the raw bytes, so the decode is exact; a lone
    ``\\r`` is not a separator.  Columns: line_no (file order), value."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.monotonically_increasing_id().alias("line_no"),
                      F.decode(F.col("value").cast("binary"), encoding).alias("value"))


def classify_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Per line: stripped text, sentence, label id and the reject reason
    (``blank``, ``no_delimiter``, ``unknown_label`` or NULL)."""
    line = ustrip(F.coalesce(F.col(value), F.lit("")))
    before, after = split_last(line, "@")
    lab = label_id(after)
    reason = (F.when(line == "", F.lit("blank"))
              .when(~line.contains("@"), F.lit("no_delimiter"))
              .when(lab.isNull(), F.lit("unknown_label")))
    keep = [c for c in lines.columns if c != value]
    return lines.select(*keep, ustrip(before).alias("sentence"), lab.alias("label"),
                        reason.alias("reject"))


def parse_corpus(lines: DataFrame, value: str = "value") -> DataFrame:
    """Valid (sentence, label) rows; split on the last '@',
    label stripped and lower-cased, unknown labels dropped."""
    c = classify_lines(lines, value)
    return c.filter(F.col("reject").isNull()).drop("reject")


def corpus_audit(lines: DataFrame, value: str = "value") -> DataFrame:
    """P6/P7 counters in one pass: lines, blank, no delimiter, unknown label
    and kept rows."""
    c = classify_lines(lines, value)
    r = F.col("reject")
    return c.agg(F.count(F.lit(1)).alias("n_lines"),
                 F.count_if(r == "blank").alias("n_blank"),
                 F.count_if(r == "no_delimiter").alias("n_no_delimiter"),
                 F.count_if(r == "unknown_label").alias("n_unknown_label"),
                 F.count_if(r.isNull()).alias("n_rows"))


def _per_label(df: DataFrame, label: str, value: F.Column | None = None) -> DataFrame:
    """One row holding ``c = array<struct<label, n>>`` sorted by label.

    The array has one entry per class (the label map is fixed, so it is
    bounded by the class count, never by the data); the counts behind it
    come from a partial aggregate.  Per-class arithmetic over the whole set
    (shares, quotas) then runs on that array with higher-order functions:
    no window over an unpartitioned frame and no join."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("c"))


def _total(arr: F.Column, field: str) -> F.Column:
    """Sum of ``field`` over an array of structs."""
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: count and percentage per label (ascending), with a text bar."""
    names = F.array(*[F.lit(x.capitalize()) for x in LABELS])
    per = _per_label(df, label).withColumn("_tot", _total(F.col("c"), "n"))
    rows = per.select(F.inline(F.transform(
        "c", lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"),
                                (x["n"] / F.col("_tot") * 100.0).alias("pct")))))
    return rows.select("label", F.get(names, F.col("label")).alias("label_name"),
                       "n", "pct", pct_bar(F.col("pct")).alias("bar"))


def _largest_remainder(one: DataFrame, w: list[F.Column], draws: F.Column, out: str) -> DataFrame:
    """Quota per class for the weight columns ``w`` of the one-row frame
    ``one``: floor(draws * w_i / W) plus one for the classes with the
    largest remainders (ties: lower class first) until ``draws`` is met.
    Absent classes (w_i = 0) take no share.  Adds ``{out}0..``.  Three
    projections, so no large expression is inlined more than once."""
    k = len(w)
    total = sum(w[1:], w[0])
    one = one.select("*", *[F.try_divide(draws.cast("double") * w[i], total).alias(f"_c{i}")
                            for i in range(k)])
    fl = [F.floor(F.col(f"_c{i}")).cast("bigint") for i in range(k)]
    one = one.select("*", *[fl[i].alias(f"_f{i}") for i in range(k)],
                     *[(F.col(f"_c{i}") - fl[i]).alias(f"_r{i}") for i in range(k)],
                     (draws - sum(fl[1:], fl[0])).alias("_need"))
    quotas = []
    for i in range(k):
        ri = F.col(f"_r{i}")
        ahead = [F.when((w[j] > 0) & ((F.col(f"_r{j}") > ri) | ((F.col(f"_r{j}") == ri) & F.lit(j < i))), 1)
                 .otherwise(0) for j in range(k) if j != i]
        bonus = F.when((w[i] > 0) & (sum(ahead[1:], ahead[0]) < F.col("_need")), 1).otherwise(0)
        quotas.append((F.col(f"_f{i}") + bonus).alias(f"{out}{i}"))
    helpers = ["_need"] + [f"_{p}{i}" for p in "cfr" for i in range(k)]
    return one.select(*[c for c in one.columns if c not in helpers], *quotas)


def split_quotas(df: DataFrame, test_size: float = 0.30, second_test: float = 0.50,
                 label: str = "label") -> DataFrame:
    """Exact per-label split sizes: ``n_temp = ceil(test_size * n)``, then
    the temp block split with ``ceil(second_test * n_temp)`` for test.
    Output: label, n, n_train, n_validation, n_test (one row per present
    label).

    The class set is the fixed label map, so the counts are one partial
    aggregate with a conditional count per class (one row); the quota
    arithmetic is scalar over that row and the result is unpivoted."""
    one = df.agg(*[F.count_if(F.col(label) == i).alias(f"_n{i}") for i in range(len(LABELS))])
    return _quotas(one, test_size, second_test, df.schema[label].dataType)


def _quotas(one: DataFrame, test_size: float, second_test: float, ltype) -> DataFrame:
    """``split_quotas`` from the one-row frame of class counts ``_n0..``."""
    k = len(LABELS)
    n = [F.col(f"_n{i}") for i in range(k)]
    n_all = sum(n[1:], n[0])
    one = _largest_remainder(one, n, n_all - F.ceil(F.lit(test_size) * n_all), "_tr")
    one = one.select("*", *[(F.col(f"_n{i}") - F.col(f"_tr{i}")).alias(f"_t{i}") for i in range(k)])
    t = [F.col(f"_t{i}") for i in range(k)]
    t_all = sum(t[1:], t[0])
    one = _largest_remainder(one, t, t_all - F.ceil(F.lit(second_test) * t_all), "_va")
    rows = F.array(*[F.struct(F.lit(i).cast(ltype).alias("label"), F.col(f"_n{i}").alias("n"),
                              F.col(f"_tr{i}").alias("n_train"), F.col(f"_va{i}").alias("n_validation"),
                              (F.col(f"_t{i}") - F.col(f"_va{i}")).alias("n_test")) for i in range(k)])
    return one.select(F.inline(rows)).filter(F.col("n") > 0)


def stratified_split(df: DataFrame, seed: int = 42, test_size: float = 0.30,
                     second_test: float = 0.50, label: str = "label",
                     key: tuple[str, ...] = ("line_no",), cells_bits: int = 8) -> DataFrame:
    """Exact stratified train/validation/test split with a ``split``
    column; per-label sizes follow ``split_quotas``.

    Rows are ranked inside their label by ``xxhash64(seed, sentence)``; ``key``
    only orders equal sentences, which are interchangeable, so the split does
    not depend on how the input was read.  Rows whose label is not in the
    label map keep a NULL ``split``.
    A label holding a third of the data is not one task: the rank is a
    ``row_number`` per (label, hash cell) plus the cell's offset, taken from a
    small (label, cell) count table.  Deterministic for a fixed seed."""
    keys = [F.col(k) for k in key]
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col("sentence"), F.lit("")))
    # offsets table: (label x 2^cells_bits) rows, bounded by the fixed label
    # map and the cell parameter, never by the data -> safe to broadcast
    ranked, counts = distributed_rank(df.withColumn("_h", h), [label],
                                      F.shiftright(F.col("_h"), 64 - cells_bits),
                                      [F.col("_h"), *keys], out="_rank",
                                      broadcast_offsets=True, with_counts=True)
    # class totals from the rank's (label, cell) count table: no extra pass
    # over the corpus
    one = counts.agg(*[F.coalesce(F.sum(F.when(F.col(label) == i, F.col("_cn"))),
                                  F.lit(0)).cast("bigint").alias(f"_n{i}")
                       for i in range(len(LABELS))])
    q = _quotas(one, test_size, second_test, df.schema[label].dataType).select(
        F.col("label").alias(label), "n_train", "n_validation")
    out = ranked.join(F.broadcast(q), label, "left")
    split = (F.when(F.col("_rank") < F.col("n_train"), F.lit("train"))
             .when(F.col("_rank") < F.col("n_train") + F.col("n_validation"), F.lit("validation"))
             .when(F.col("n_train").isNotNull(), F.lit("test")))
    return out.withColumn("split", split).drop("_h", "_rank", "n_train", "n_validation")


def split_ratios(df: DataFrame, label: str = "label") -> DataFrame:
    """A4: class share per split (0 when absent), pivoted to one column per
    class name."""
    counts = df.groupBy("split").pivot(label, list(range(len(LABELS)))).count()
    total = sum(F.coalesce(F.col(f"`{i}`"), F.lit(0)) for i in range(len(LABELS)))
    return counts.select("split", *[
        (F.coalesce(F.col(f"`{i}`"), F.lit(0)) / total).alias(name)
        for i, name in enumerate(LABELS)])


def write_splits(df: DataFrame, path: str) -> None:
    """S7 sink: one Parquet dataset partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S7 source: the dataset, optionally one split (partition pruning).
    A missing path raises, as a missing saved dataset does."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def split_roundtrip(df: DataFrame, base_dir: str) -> DataFrame:
    """Write the splits under a fresh folder of ``base_dir`` and read back."""
    path = f"{base_dir.rstrip('/')}/splits-{uuid.uuid4().hex}"
    write_splits(df, path)
    return read_split(df.sparkSession, path)
