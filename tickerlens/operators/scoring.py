"""Scoring side: score store (S12, J2), backlog (P2, L1), batch scorer (M1,
L2) and decode of model outputs (F11, F12).

Scores are append-only rows ``(headline_hash, sentiment_label, confidence,
attention_keyword, model_version, score_seq)``; the effective score of a
headline is the latest row for its hash (``max_by`` - partial on the map
side).  A hash that is not stored is never attached (inner to headlines).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import attention_keyword, best_of_window, decode_logits, token_keyword

SCORE_FIELDS = ["sentiment_label", "confidence", "attention_keyword", "model_version"]
ORDER_COLS = ["batch_id", "ticker_pos", "feed_rank"]


def latest_scores(scores: DataFrame, seq: str = "score_seq") -> DataFrame:
    """Latest score row per headline hash (Q17)."""
    return (scores.groupBy("headline_hash")
            .agg(F.max_by(F.struct(*SCORE_FIELDS), F.col(seq)).alias("s"))
            .select("headline_hash", "s.*"))


def with_latest_scores(headlines: DataFrame, scores: DataFrame) -> DataFrame:
    """Headlines with their latest score; unscored headlines keep NULLs."""
    return headlines.join(latest_scores(scores), "headline_hash", "left")


def unscored(headlines: DataFrame, scores: DataFrame, limit: int | None = None,
             order=ORDER_COLS) -> DataFrame:
    """Headlines without any score, oldest arrival first.

    Without ``limit`` the whole backlog is returned (the drain operator);
    with it, an ordered take of the ``limit`` oldest (TakeOrderedAndProject).
    """
    backlog = headlines.join(scores.select("headline_hash"), "headline_hash", "left_anti")
    if limit is None:
        return backlog
    return backlog.orderBy(*order).limit(limit)


def decode_outputs(outputs: DataFrame, model_version: str) -> DataFrame:
    """F11 + F12 over model outputs (logits, tokens, attention, length)."""
    d = decode_logits("logits")
    return outputs.select(
        "headline_hash",
        d["label"].alias("sentiment_label"),
        d["confidence"].alias("confidence"),
        attention_keyword("tokens", "attention", "length").alias("attention_keyword"),
        F.lit(model_version).alias("model_version"))


def decode_windows(outputs: DataFrame, model_version: str) -> DataFrame:
    """F11 + F12 over the windows of whole headlines: one row per hash, that
    of its first line (least ``doc_id``).  The keyword is the best token of all
    windows of that line.  One partial aggregate; a row per window is made
    small before the shuffle."""
    d = decode_logits("logits")
    rated = outputs.select(
        "headline_hash",
        F.struct((-F.col("doc_id")).alias("neg_doc"),
                 best_of_window("tokens", "attention", "length", "window").alias("best"),
                 (-F.col("window")).alias("neg_window"), d["label"].alias("label"),
                 d["confidence"].alias("confidence")).alias("o"))
    one = rated.groupBy("headline_hash").agg(F.max("o").alias("o"))
    return one.select(
        "headline_hash",
        F.col("o.label").alias("sentiment_label"),
        F.col("o.confidence").alias("confidence"),
        token_keyword(F.col("o.best.tok")).alias("attention_keyword"),
        F.lit(model_version).alias("model_version"))


class Scorer(Protocol):
    """Pluggable model for ``score_in_pandas``.

    ``load()`` runs once per Python worker (cached under ``cache_key`` or the
    class name); ``logits(texts)`` returns an ``n x 3`` array-like for a
    batch of texts.  Decode stays in the JVM.
    """

    def load(self) -> None: ...

    def logits(self, texts: pd.Series): ...


_LOADED: dict[str, object] = {}


def score_in_pandas(df: DataFrame, scorer: Scorer, text: str = "headline",
                    model_version: str = "custom") -> DataFrame:
    """M1/L2: run a Python scorer over the whole backlog in Arrow batches.

    ``spark.sql.execution.arrow.maxRecordsPerBatch`` is the forward batch;
    the scorer is loaded once per worker process and reused.  The output
    carries logits only; label and confidence are decoded natively."""
    # stable across task deserialisation, so a reused Python worker keeps
    # the loaded model between tasks (``id()`` would change every task)
    key = getattr(scorer, "cache_key", None) or \
        f"{type(scorer).__module__}.{type(scorer).__qualname__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # look the cache up on the imported module inside the worker: a
        # module global referenced by this closure would be pickled by value
        import importlib
        cache = importlib.import_module(__name__)._LOADED
        model = cache.get(key)
        if model is None:
            scorer.load()
            cache[key] = scorer
            model = scorer
        for pdf in batches:
            lg = model.logits(pdf[text].fillna(""))
            yield pd.DataFrame({"headline_hash": pdf["headline_hash"],
                                "logits": [list(map(float, r)) for r in lg]})

    raw = df.select("headline_hash", text).mapInPandas(
        run, "headline_hash string, logits array<double>")
    d = decode_logits("logits")
    return raw.select("headline_hash", d["label"].alias("sentiment_label"),
                      d["confidence"].alias("confidence"),
                      F.lit(None).cast("string").alias("attention_keyword"),
                      F.lit(model_version).alias("model_version"))


def score_with_pipeline(df: DataFrame, model, model_version: str,
                        text: str = "headline") -> DataFrame:
    """M1 with an MLlib ``PipelineModel`` (the default scorer here).

    Label = argmax of the probability vector, confidence = its max.  The
    keyword analogue is the headline token with the largest coefficient for
    the predicted class (see ``operators.ml.keyword_by_coefficients``)."""
    from pyspark.ml.functions import vector_to_array

    from .ml import keyword_by_coefficients

    scored = model.transform(df.withColumnRenamed(text, "sentence")
                             if text != "sentence" else df)
    prob = vector_to_array("probability")
    pred = F.col("prediction").cast("int")
    base = scored.select(
        "headline_hash", "tokens", pred.alias("pred"),
        F.array_max(prob).alias("confidence"))
    kw = keyword_by_coefficients(base, model)
    from ..functions.text import label_text
    return kw.select("headline_hash", label_text("pred").alias("sentiment_label"),
                     "confidence", "attention_keyword",
                     F.lit(model_version).alias("model_version"))
