"""Toxicity by compression distance.

Two zstandard dictionaries come from a bounded sample of labelled rows: one is
trained on ordinary text, the other is the first one plus a list of the words
of toxic text that it lacks and that stand in significantly more toxic than
ordinary texts (training on toxic text itself measured worse, see README).  Every window of a few words is compressed with both; a
window that the toxic dictionary shortens more looks toxic.  The largest
savings, their number and the number of windows are calibrated to a
probability by logistic regression on the same sample (weighted back to the
class shares of all labelled rows).  Scoring reads whole texts in one Arrow
UDF and shuffles nothing.

Defined results: NULL and empty texts score like a text without savings; with
labels of one class only, every text gets that class's share; every row is
scored by itself, so repeated rows have equal scores; a NULL id is in no fold
(``held_out`` is NULL) and is never learnt from; a very long text is scored over
all its windows; an empty table gives an empty table; neither labels nor language, source or id enter a score.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TRAIN_ROWS = 2000             # labelled rows per class, the bound of the sample
WINDOW_WORDS = 8
BASE_BYTES = 128 << 10        # dictionary of ordinary text
TOXIC_SEGMENTS = 600          # segments that toxic text adds to it
MIN_SEGMENT = 6               # bytes of a segment, spaces included
MIN_Z = 6.0                   # how much more frequent it is in toxic texts
LIMIT = 0.3                   # score from which a text counts as toxic
FOLDS, HELD_OUT = 4, 2        # crc32(id) mod FOLDS = HELD_OUT is never learnt
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]      # intercept first; empty: constant share
    share: float


def _segments(text: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().split()]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    import zstandard
    samples = [b"".join(_segments(t)) for t in ordinary]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples, k=64, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):      # too few samples to train on
        base = b"".join(samples)[:BASE_BYTES]
    seen = Counter(s for t in toxic for s in set(_segments(t)))
    usual = Counter(s for t in ordinary for s in set(_segments(t)))
    nt, no = len(toxic), len(ordinary)
    rated = []
    for s, c in seen.items():
        if len(s) < MIN_SEGMENT or s in base:
            continue
        p = (c + usual[s]) / (nt + no)
        spread = math.sqrt(p * (1 - p) * (1 / nt + 1 / no)) or 1e-9
        z = (c / nt - usual[s] / no) / spread
        if z >= MIN_Z:
            rated.append((z, s))
    best = sorted(rated, key=lambda x: (-x[0], x[1]))[:TOXIC_SEGMENTS]
    return base, b"".join(s for _, s in reversed(best)) + base


def _compressor(content: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, hash_log=18,
        chain_log=18, search_log=6, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_checksum=0, write_content_size=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


@functools.lru_cache(maxsize=2)
def _pair(ordinary: bytes, toxic: bytes):
    return _compressor(ordinary), _compressor(toxic)


def savings(text: str | bytes | None, ordinary: bytes, toxic: bytes) -> tuple[float, ...]:
    """Features of a text: largest saving of a window, sum of the three
    largest, log of the number of clear savings, log of the windows."""
    plain, tox = _pair(ordinary, toxic)
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else (text or b"")
    ws = raw.lower().split()
    gain = []
    a, b, n = plain.compress, tox.compress, WINDOW_WORDS
    for k in range(0, len(ws), n):
        w = b" " + b" ".join(ws[k:k + n]) + b" "
        gain.append(len(a(w)) - len(b(w)))
    top = sorted(gain, reverse=True)[:3]
    return (float(top[0]) if top else 0.0, float(sum(top)),
            math.log1p(sum(g >= 3 for g in gain)), math.log1p(len(gain)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = 1e-3 * weight.sum() * np.eye(a.shape[1])
    ridge[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(a.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(id_col: Column | str) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT


def _features(df: DataFrame, ordinary: bytes, toxic: bytes, text_col: str, out: str) -> DataFrame:
    both = df.sparkSession.sparkContext.broadcast((ordinary, toxic))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([savings(t, *both.value) for t in s], columns=list("abcd"))

    udf = F.pandas_udf(run, "struct<a: double, b: double, c: double, d: double>")
    return df.withColumn(out, udf(F.col(f"`{text_col}`").cast("string")))


def train(texts: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Dictionaries and calibration from at most ``rows`` labelled texts of
    each class (those with the smallest hash of their id), none held out."""
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
           .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
           .groupBy("id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(b"", b"", (), share)
    picked = None
    for y in (0, 1):
        part = lab.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        picked = part if picked is None else picked.union(part)
    own = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = own.join(F.broadcast(picked), "id").filter(F.col("text").isNotNull())
    got = [(r["y"], r["text"].encode("utf-8", "replace")) for r in sample.collect()]
    ordinary, toxic = ([t for y, t in got if y == c] for c in (0, 1))
    if not ordinary or not toxic:
        return Model(b"", b"", (), share)
    dicts = train_dictionaries(toxic, ordinary)
    rated = _features(sample.select("y", "text"), *dicts, "text", "f").select("y", "f.*").collect()
    x = np.array([[r[c] for c in "abcd"] for r in rated])
    y = np.array([r["y"] for r in rated], float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(*dicts, _fit(x, y, weight), share)


def score(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of a toxic text."""
    if not model.weights:
        return df.withColumn(score_col, F.lit(float(model.share)))
    from .common import hidden
    f, = hidden(df, "savings")
    z = F.lit(model.weights[0])
    for name, w in zip("abcd", model.weights[1:], strict=True):
        z = z + F.lit(w) * F.col(f)[name]
    rated = _features(df, model.ordinary, model.toxic, text_col, f)
    return rated.withColumn(score_col, 1 / (1 + F.exp(-z))).drop(f)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"))
