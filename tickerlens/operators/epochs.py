"""M3 by epochs: a softmax classifier trained by mini-batches, saved after
every epoch, resumed where it stopped, the best epoch kept by macro-F1.

Training rows are stored once, partitioned by mini-batch, so a step reads its
own rows only.  A step is one job: every task adds up the gradient of its rows
in Arrow batches, the sums of the tasks meet in one aggregation, and at most
``width`` + 1 rows of three numbers come back (``width`` is a parameter, not a
property of the data).  The weights go out with the next step.

Gradients are means over the mini-batch; weights shrink by ``rate * decay`` in
every step (decoupled weight decay).  Bucket -1 is the bias of a row.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import TOKEN_PATTERN, word_tokens
from ..sources.tables import create_if_absent
from .ml import macro_metrics

N_CLASSES = 3
CACHE_TOKENS = 100_000        # token places a scoring worker remembers
_GAPS = re.compile(TOKEN_PATTERN)
WEIGHT_SCHEMA = "bucket int, w0 double, w1 double, w2 double"
ROW_SCHEMA = "label int, buckets array<int>, shares array<double>"
METRIC_SCHEMA = ("epoch int, loss double, val_accuracy double, val_precision double, val_recall double, "
                 "val_f1 double")
REPORT = [f.split()[0] for f in METRIC_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Plan:
    """Parameters of a training run."""
    epochs: int = 3
    steps: int = 8
    rate: float = 8.0
    decay: float = 0.0005
    width: int = 1 << 13


def digest_number(text: Column) -> Column:
    """The first 32 bits of a SHA-256 digest (the same in every engine)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def hashed_rows(df: DataFrame, plan: Plan, text: str = "sentence", row_id: str = "line_no") -> DataFrame:
    """``df`` with its mini-batch (``step``) and its features: buckets of its
    lower-case tokens and their shares of the tokens, bucket -1 with 1 first.
    Tokens are split in the JVM; a column of Arrow batches counts them, so a
    filter on other columns still reaches the source."""
    width, known = plan.width, {}

    def features(tokens: pa.Array) -> pa.Array:
        return _features(tokens, width, known)

    f = F.arrow_udf(features, "struct<buckets: array<int>, shares: array<double>>")(word_tokens(text))
    rows = df.withColumn("_f", f)
    return rows.withColumns({
        "buckets": F.col("_f.buckets"), "shares": F.col("_f.shares"),
        "step": (digest_number(F.concat(F.lit("step:"), F.col(row_id).cast("string"))) % plan.steps).cast("int"),
    }).drop("_f")


def _features(tokens: pa.Array, width: int, known: dict[str, int]) -> pa.StructArray:
    """Buckets and shares of rows of tokens; every distinct token of the batch is
    looked up once.  A row without a token has bucket -1 alone, a NULL row NULL."""
    n, size = len(tokens), tokens.value_lengths().fill_null(0).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    bucket = np.array([_bucket(t, width, known) for t in coded.dictionary.to_pylist()], np.int64)
    # one number for row and bucket: sorted, they are the rows' features in order
    at = np.repeat(np.arange(n, dtype=np.int64), size) * width + bucket[coded.indices.to_numpy()]
    at, count = np.unique(at, return_counts=True)
    row = at // width
    valid = tokens.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(row, minlength=n) + valid)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    first = offsets[:-1][valid]
    buckets, shares = np.full(offsets[-1], -1, np.int32), np.ones(offsets[-1])
    rest = np.ones(offsets[-1], bool)
    rest[first] = False
    buckets[rest], shares[rest] = at % width, count / size[row]
    gaps = pa.array(offsets, pa.int32(), mask=np.append(~valid, False))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(gaps, pa.array(buckets)), pa.ListArray.from_arrays(gaps, pa.array(shares))],
        names=["buckets", "shares"])


def _bucket(token: str, width: int, known: dict[str, int]) -> int:
    at = known.get(token)
    if at is None:
        if len(known) >= CACHE_TOKENS:
            known.clear()
        digest = hashlib.sha256(token.encode("utf-8")).digest()
        at = known[token] = int.from_bytes(digest[:4], "big") % width
    return at


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket + 1 and share of every feature of a batch."""
    b, s = batch.column("buckets"), batch.column("shares")
    sizes = np.diff(b.offsets.to_numpy())
    return (np.repeat(np.arange(len(sizes)), sizes), b.flatten().to_numpy().astype(np.int64) + 1,
            s.flatten().to_numpy())


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place ``at``, one column a class."""
    return np.stack([np.bincount(at, values[:, c], n) for c in range(N_CLASSES)], axis=1)


def probabilities(rows: np.ndarray, at: np.ndarray, share: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    logits = _sums(rows, share[:, None] * weights[at], n)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sum of the gradients and of the losses over ``rows``, and their number."""
    out = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, n, loss = out.value, np.zeros_like(out.value), 0, 0.0
        for b in batches:
            row, at, share = _arrays(b)
            label = b.column("label").to_numpy().astype(np.int64)
            p = probabilities(row, at, share, b.num_rows, w)
            loss -= float(np.log(p[np.arange(len(label)), label]).sum())
            p[np.arange(len(label)), label] -= 1.0
            total += _sums(at, share[:, None] * p[row], len(total))
            n += b.num_rows
        held = np.flatnonzero(total.any(axis=1))
        # the count and the loss travel as a row of their own
        cols = [np.append(held, -1), *(np.append(total[held, c], x) for c, x in enumerate((float(n), loss, 0.0)))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), *map(pa.array, cols[1:])],
                                         names=["at", "g0", "g1", "g2"])
    sums = rows.select("label", "buckets", "shares").mapInArrow(
        run, "at bigint, g0 double, g1 double, g2 double").groupBy("at").agg(
        *[F.sum(f"g{c}").alias(f"g{c}") for c in range(N_CLASSES)]).toPandas()
    grad, n, loss = np.zeros_like(weights), 0, 0.0
    body = sums[sums["at"] >= 0]
    grad[body["at"].to_numpy()] = body[["g0", "g1", "g2"]].to_numpy()
    for r in sums[sums["at"] < 0].itertuples():
        n, loss = int(r.g0), float(r.g1)
    out.unpersist()
    return grad, loss, n


def predict(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """label and prediction (the least of equally likely classes) of ``rows``."""
    out = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(*_arrays(b), b.num_rows, out.value)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(p.argmax(axis=1).astype(np.int32))],
                                             names=["label", "prediction"])
    return rows.select(F.col("label").cast("int").alias("label"), "buckets", "shares").mapInArrow(
        run, "label int, prediction int")


class EpochScorer:
    """The trained weights as a model for ``scoring.score_in_pandas``: logits of
    whole texts in Arrow batches.  The weights are bounded by ``width`` and go
    with the task; a worker keeps one model per set of weights."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.width = weights, len(weights) - 1
        self.cache_key = f"epochs-{hashlib.sha256(weights.tobytes()).hexdigest()}"

    def load(self) -> None:
        self.known: dict[str, int] = {}

    def logits(self, texts: pd.Series) -> np.ndarray:
        tokens = [[t for t in _GAPS.split(x.lower()) if t] for x in texts]
        size = np.array(list(map(len, tokens)))
        at = np.array([_bucket(t, self.width, self.known) + 1 for ts in tokens for t in ts], np.int64)
        row = np.repeat(np.arange(len(tokens)), size)
        return self.weights[:1] + _sums(row, self.weights[at] / size[row][:, None], len(tokens))


# ------------------------------------------------------------ saved epochs ----

def _save(spark: SparkSession, path: str, epoch: int, weights: np.ndarray, metrics: tuple) -> None:
    """Weights first, metrics last: an epoch without metrics is not finished."""
    pdf = pd.DataFrame(weights, columns=["w0", "w1", "w2"])
    pdf.insert(0, "bucket", np.arange(-1, len(weights) - 1, dtype=np.int32))
    spark.createDataFrame(pdf, WEIGHT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/weights/epoch={epoch}")
    (spark.createDataFrame([metrics], METRIC_SCHEMA).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{path}/metrics"))


def load_weights(spark: SparkSession, path: str, epoch: int) -> np.ndarray:
    rows = spark.read.schema(WEIGHT_SCHEMA).parquet(f"{path}/weights/epoch={epoch}").toPandas()
    return rows.sort_values("bucket")[["w0", "w1", "w2"]].to_numpy()


def finished(spark: SparkSession, path: str, epochs: int) -> list:
    """Metrics of the finished epochs, from the first without a gap (one row
    an epoch)."""
    create_if_absent(spark, f"{path}/metrics", spark.createDataFrame([], METRIC_SCHEMA).schema, ("epoch",))
    rows = {r["epoch"]: r for r in spark.read.schema(METRIC_SCHEMA).parquet(f"{path}/metrics")
            .select(*REPORT).collect()}
    return [rows[k] for k in itertools.takewhile(rows.__contains__, range(epochs))]


def best_epoch(report: list) -> int:
    """The epoch of the highest validation macro-F1, the first of equal ones."""
    return max(report, key=lambda r: (r["val_f1"], -r["epoch"]))["epoch"]


def store_rows(rows: DataFrame, path: str, subset: Column) -> DataFrame:
    """Rows of ``hashed_rows`` written once, by subset and mini-batch, and read
    back: training, validation and test each read their own files."""
    (rows.withColumn("subset", subset).select("label", "buckets", "shares", "subset", "step")
     .write.mode("overwrite").partitionBy("subset", "step").parquet(path))
    return rows.sparkSession.read.schema(ROW_SCHEMA + ", subset string, step int").parquet(path)


def train_epochs(train: DataFrame, validation: DataFrame, path: str, plan: Plan = Plan(), stored: bool = False
                 ) -> tuple[np.ndarray, DataFrame]:
    """Weights of the best epoch and the report of all.  ``train`` and
    ``validation`` are rows of ``hashed_rows``; what an earlier run finished
    under ``path`` is not trained again.  With ``stored`` they are rows of
    ``store_rows``, which are not written a second time."""
    spark = train.sparkSession
    done = finished(spark, path, plan.epochs)
    if len(done) < plan.epochs:
        rows, held = train, validation
        if not stored:
            at = f"{path}/rows"
            train.select("label", "buckets", "shares", "step").write.mode("overwrite").partitionBy("step").parquet(at)
            validation.select("label", "buckets", "shares").write.mode("overwrite").parquet(f"{path}/validation")
            rows = spark.read.schema(ROW_SCHEMA + ", step int").parquet(at)
            held = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/validation")
        weights = load_weights(spark, path, len(done) - 1) if done else np.zeros((plan.width + 1, N_CLASSES))
        for epoch in range(len(done), plan.epochs):
            loss = seen = 0
            for step in range(plan.steps):
                grad, part, n = gradient(rows.filter(F.col("step") == step), weights)
                loss, seen = loss + part, seen + n
                weights = weights * (1 - plan.rate * plan.decay) - plan.rate * grad / max(n, 1)
            m = macro_metrics(predict(held, weights)).first()
            _save(spark, path, epoch, weights, (epoch, float(loss) / max(seen, 1), *(
                None if m[c] is None else float(m[c]) for c in ("accuracy", "precision", "recall", "f1"))))
        done = finished(spark, path, plan.epochs)
    best = best_epoch(done)
    report = spark.createDataFrame([(*r, r["epoch"] == best) for r in done], METRIC_SCHEMA + ", best boolean")
    return load_weights(spark, path, best), report
