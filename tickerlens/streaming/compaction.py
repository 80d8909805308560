"""The append-only score table rewritten to one row per headline, while
readers and the scoring job go on.

A generation is a whole snapshot: the latest score per hash of everything
committed when it began.  It is written beside the table under its own number,
together with the commits it covers, and counts from the moment one small row
(the mark) says so; a crash before that leaves the generation before it in
force.  Nothing is changed in place, so a reader that began earlier keeps its
files; files of generations older than the one before the last are never read
again and may be removed by the operator of the store.

Readers take the newest marked generation and the commits it does not cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scoring import SCORE_FIELDS
from ..sources.tables import COMMIT, SCORES, create_if_absent
from . import stores

MARKS = T.StructType([T.StructField("gen", T.LongType(), False), T.StructField("n_commits", T.LongType(), False)])
SNAPSHOT = T.StructType([*SCORES.fields, T.StructField("gen", T.LongType())])
COVERED = T.StructType([*COMMIT, T.StructField("gen", T.LongType())])


def _paths(scores_path: str) -> dict[str, str]:
    base = f"{scores_path.rstrip('/')}_compact"
    return {k: f"{base}/{k}" for k in ("marks", "snapshot", "covered")}


def newest_generation(spark: SparkSession, scores_path: str) -> int:
    """The newest marked generation, 0 before the first."""
    path = _paths(scores_path)["marks"]
    create_if_absent(spark, path, MARKS)
    return spark.read.schema(MARKS).parquet(path).agg(F.max("gen").alias("g")).first()["g"] or 0


def _of(spark: SparkSession, path: str, schema: T.StructType, gen: int) -> DataFrame:
    create_if_absent(spark, path, schema, ("gen",))
    return spark.read.schema(schema).parquet(path).filter(F.col("gen") == gen).drop("gen")


def _parts(spark: SparkSession, scores_path: str, gen: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a generation, and the rows of the commits it does not cover."""
    p = _paths(scores_path)
    covered = _of(spark, p["covered"], COVERED, gen)
    table = stores.open_table(spark, scores_path, "scores")
    return _of(spark, p["snapshot"], SNAPSHOT, gen), table.join(covered, list(stores.COMMIT_COLS), "left_anti")


def effective_scores(spark: SparkSession, scores_path: str) -> DataFrame:
    """The latest score of every hash: one row per hash."""
    snapshot, rest = _parts(spark, scores_path, newest_generation(spark, scores_path))
    cols = [f.name for f in SCORES.fields]
    both = snapshot.select(*cols, F.lit(0).alias("late")).unionByName(rest.select(*cols, F.lit(1).alias("late")))
    return _latest(both)


def _latest(rows: DataFrame) -> DataFrame:
    """Later writes win; a commit beats the snapshot it follows; among equal
    writes the greatest row, so that every reader sees the same."""
    order = F.struct("score_seq", *([F.col("late")] if "late" in rows.columns else []), *SCORE_FIELDS)
    one = rows.groupBy("headline_hash").agg(F.max(order).alias("s"))
    return one.select("headline_hash", *[F.col(f"s.{c}").alias(c) for c in (*SCORE_FIELDS, "score_seq")])


def compact(spark: SparkSession, scores_path: str) -> int:
    """Write the next generation; its number.  Commits that appear while it is
    written are not covered by it and stay visible beside it."""
    gen = newest_generation(spark, scores_path)
    p = _paths(scores_path)
    table = stores.open_table(spark, scores_path, "scores")
    covered = table.select(*stores.COMMIT_COLS).distinct()
    _write(covered.withColumn("gen", F.lit(gen + 1).cast("bigint")), p["covered"])
    # the commits of this generation are fixed from here on, by what was written
    fixed = _of(spark, p["covered"], COVERED, gen + 1)
    snapshot, rest = _parts(spark, scores_path, gen)
    cols = [f.name for f in SCORES.fields]
    new = rest.join(fixed, list(stores.COMMIT_COLS), "left_semi")
    both = snapshot.select(*cols, F.lit(0).alias("late")).unionByName(new.select(*cols, F.lit(1).alias("late")))
    rows = _latest(both).select(*cols).withColumn("gen", F.lit(gen + 1).cast("bigint"))
    _write(rows, p["snapshot"])
    n = fixed.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    spark.createDataFrame([(gen + 1, n)], MARKS).coalesce(1).write.mode("append").parquet(p["marks"])
    return gen + 1


def _write(df: DataFrame, path: str) -> None:
    """The generation's own partition; what a crash left there is replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen").parquet(path))


def snapshot_path(scores_path: str, gen: int) -> str:
    """Files of one generation: one row per hash, for counts from footers."""
    return f"{_paths(scores_path)['snapshot']}/gen={gen}"
