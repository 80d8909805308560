"""Corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns the columns of ``documents``; the last one adds the token ids.

Whole texts travel to the Python workers in Arrow batches.  A batch is held
several times over (in the JVM, as strings, as results), so the stages ask for
at most ``BATCH_ROWS`` texts a batch; a smaller setting of the session stays.

Defined results: rows with a NULL, empty or blank text go in the first stage
(too few words); rows without an id are kept or dropped by their text in every
stage; of equal texts the one with the smallest id stays; repeated rows of one
id are one document in the third stage; very long texts are read whole; an
empty table stays empty; further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlens.llm.bpe import encode_decode, n_ids
from tickerlens.llm.common import stored, table
from tickerlens.llm.decontam import benchmark_leaks
from tickerlens.llm.jaccard_orders import link_classes
from tickerlens.llm.line_dedup import drop_site_lines
from tickerlens.llm.quality_rules import quality_cascade


# --- fixed values -----------------------------------------------------------
BATCH_ROWS = 1000             # texts of an Arrow batch
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# ---------------------------------------------------------------------------


def _small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_cascade(docs, kept_col="__kept", kept_only=True).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` of a
    changed text is counted anew."""
    out = drop_site_lines(docs, F.col("source"), dropped_col="__dropped")
    n = F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates (five-word shingles,
    Jaccard 0.8 or more): the one with the smallest id."""
    _small_batches(spark)
    classes = link_classes(docs.select("doc_id", "text"), k=5, pct=80)
    gone = stored(classes.filter("component_id < doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    leaks = benchmark_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(leaks.select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids (packed, 4 bytes each), their number
    and whether they decode to the text."""
    _small_batches(spark)
    import public_tokenizers
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, decoded_col="__decoded")
    same = F.col("__decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumns({"n_tokens": n_ids("ids"), "round_trip": same}).drop("__decoded")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

# Edit distance over windows and BPE merges are not expressible in SQL; the
# stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
