"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# --- fixed values -----------------------------------------------------------
WORD_GAP = r"[\x20\x09-\x0D]+"          # what separates words
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GAP_CHARS = " \t\n\x0b\x0c\r"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column | str) -> Column:
    """Words of a text in order, unchanged; NULL or blank text gives []."""
    text = F.col(text) if isinstance(text, str) else text
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(
        F.split(core, WORD_GAP))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder
    and read it back: lineage is cut, a lost executor costs nothing that was
    written, and the planner sees the real size of the table.  The shuffle
    files of the write go when it ends (a session setting of Spark, put back
    afterwards), so a job of many steps holds those of one step at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tickerlens-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        x = f"__{n}"
        while x.lower() in taken:
            x = "_" + x
        out.append(x)
        taken.add(x.lower())
    return out


def hash64(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)
