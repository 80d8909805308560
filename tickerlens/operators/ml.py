"""Classifier side: tokenisation (M2), macro metrics (A5), model selection
(M3) and held-out evaluation (M4) on Spark MLlib.

The reference fine-tunes a transformer; that library is not available
here, so the default model is an MLlib multinomial logistic regression over
token counts with IDF.  Its numbers are this model's, never the reference's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import TOKEN_PATTERN, word_tokens

FEATURE_WIDTH = 1 << 15       # hash buckets of the token counts
DEFAULT_GRID = ({"reg_param": 0.0}, {"reg_param": 0.01}, {"reg_param": 0.1})


def tokenize(df: DataFrame, max_len: int = 512, text: str = "sentence") -> DataFrame:
    """M2: lower-case whitespace tokens truncated to ``max_len``; the text
    column is dropped."""
    return df.withColumn("tokens", F.slice(word_tokens(text), 1, max_len)).drop(text)


def macro_metrics(df: DataFrame, label: str = "label",
                  prediction: str = "prediction") -> DataFrame:
    """A5: accuracy and macro precision / recall / F1 (zero division -> 0).

    Classes are those seen in the truth or the prediction.  The data is
    reduced to the confusion counts first (partial aggregation), so the
    rest works on at most classes^2 rows."""
    conf = (df.select(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p"))
            .groupBy("t", "p").agg(F.count(F.lit(1)).alias("n")))
    contrib = conf.select(F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("x.*")
    per = contrib.groupBy("c").agg(F.sum("true_n").alias("tn"), F.sum("pred_n").alias("pn"),
                                   F.sum("tp").alias("tp"))
    p = F.when(F.col("pn") > 0, F.col("tp") / F.col("pn")).otherwise(0.0)
    r = F.when(F.col("tn") > 0, F.col("tp") / F.col("tn")).otherwise(0.0)
    per = per.select("tp", "tn", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0,
                2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per.agg((F.sum("tp") / F.sum("tn")).alias("accuracy"),
                   F.avg("p").alias("precision"), F.avg("r").alias("recall"),
                   F.avg(f1).alias("f1"))


def feature_pipeline(spark: SparkSession, width: int = FEATURE_WIDTH) -> Pipeline:
    """Tokens -> counts over ``width`` hash buckets -> IDF.  Every token has a
    bucket, seen in training or not; no vocabulary is built."""
    tok = RegexTokenizer(inputCol="sentence", outputCol="tokens", pattern=TOKEN_PATTERN,
                         gaps=True, toLowercase=True, minTokenLength=1)
    bucket = SQLTransformer(statement=(
        f"SELECT *, transform(tokens, t -> {bucket_sql('t', width)}) AS buckets FROM __THIS__"))
    counts = CountVectorizerModel.from_vocabulary([str(k) for k in range(width)], "buckets", "tf")
    idf = IDF(inputCol="tf", outputCol="features")
    return Pipeline(stages=[tok, bucket, counts, idf])


def bucket_sql(token: str, width: int) -> str:
    return f"CAST(pmod(xxhash64({token}), {width}) AS STRING)"


def classifier(max_iter: int = 50, reg_param: float = 0.0) -> LogisticRegression:
    return LogisticRegression(family="multinomial", labelCol="label", featuresCol="features",
                              maxIter=max_iter, regParam=reg_param)


def train_select(train: DataFrame, validation: DataFrame,
                 grid: Sequence[dict] = DEFAULT_GRID, width: int = FEATURE_WIDTH, max_iter: int = 20):
    """M3: fit the features once on ``train``, then one classifier per grid
    point on the persisted features; keep the best by validation macro-F1
    (first wins ties).  Returns (PipelineModel, report DataFrame)."""
    feats = feature_pipeline(train.sparkSession, width).fit(train)
    tr = feats.transform(train).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    va = feats.transform(validation).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    best, best_f1, rows = None, None, []
    try:
        for i, params in enumerate(grid):
            lr = classifier(max_iter=max_iter, **params).fit(tr)
            m = macro_metrics(lr.transform(va)).first()
            f1 = float(m["f1"] or 0.0)
            rows.append((i, float(params.get("reg_param", 0.0)), float(m["accuracy"] or 0.0), f1))
            if best_f1 is None or f1 > best_f1:
                best, best_f1 = lr, f1
    finally:
        tr.unpersist()
        va.unpersist()
    model = PipelineModel(stages=feats.stages + [best])
    report = train.sparkSession.createDataFrame(
        rows, "candidate int, reg_param double, val_accuracy double, val_f1 double")
    return model, report


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """M4: macro metrics of ``model`` on the held-out split."""
    return macro_metrics(model.transform(test))


def save_model(model: PipelineModel, path: str) -> str:
    """Write the selected model; its version is the id of its last stage."""
    model.write().overwrite().save(path)
    return model_version(model)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved model, or None when there is none at ``path``."""
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return PipelineModel.load(path)


def model_version(model: PipelineModel) -> str:
    return model.stages[-1].uid


def keyword_by_coefficients(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """Keyword analogue for the linear model: the headline token whose bucket
    has the largest coefficient for the predicted class (first position on
    ties).  The coefficients are classes x ``FEATURE_WIDTH`` numbers, bounded by
    that parameter and not by the data, so they are broadcast; the best token of
    a row is found in Arrow batches, and one row per input row is aggregated."""
    coef = model.stages[-1].coefficientMatrix.toArray()
    sent = scored.sparkSession.sparkContext.broadcast(coef)

    def best(pred: pa.Array, tokens: pa.Array, buckets: pa.Array) -> pa.Array:
        return _best_tokens(sent.value, pred, tokens, buckets)

    buckets = F.expr(f"transform(tokens, t -> CAST({bucket_sql('t', coef.shape[1])} AS INT))")
    found = F.arrow_udf(best, "struct<coef: double, neg_pos: int, tok: string>")("pred", "tokens", buckets)
    rows = scored.select("headline_hash", "pred", "confidence", found.alias("b"))
    return rows.groupBy("headline_hash", "pred", "confidence").agg(
        F.max_by("b.tok", F.when(F.col("b.tok").isNotNull(), F.struct("b.coef", "b.neg_pos")))
        .alias("attention_keyword"))


def _best_tokens(coef: np.ndarray, pred: pa.Array, tokens: pa.Array, buckets: pa.Array) -> pa.StructArray:
    """Per row the token of the largest coefficient, the first of equal ones;
    NULLs for a row without tokens."""
    size = buckets.value_lengths().fill_null(0).to_numpy()
    held = np.flatnonzero(size)
    row = np.repeat(np.arange(len(size)), size)
    value = coef[pred.to_numpy(zero_copy_only=False)[row].astype(np.int64), buckets.flatten().to_numpy()]
    starts = np.cumsum(size) - size
    top = np.maximum.reduceat(value, starts[held]) if len(held) else value
    at = np.flatnonzero(value == np.repeat(top, size[held]))
    at = at[np.unique(row[at], return_index=True)[1]]     # the first of a row
    take = np.full(len(size), -1, np.int64)
    take[held] = at
    none = take < 0
    safe = pa.array(take, mask=none)
    return pa.StructArray.from_arrays(
        [pa.array(value).take(safe), pa.array((starts - take).astype(np.int32), mask=none), tokens.flatten().take(safe)],
        names=["coef", "neg_pos", "tok"])
