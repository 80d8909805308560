"""Quality classifier by co-training of two views.

One classifier sees the text (rates of symbols, capitals, digits, repeated
lines and words, ...), the other the page's metadata (source, language,
length, lines).  Both start from the labelled rows; in every round each one
labels the unlabelled documents, and what one view is confident about joins
the training rows of the other.  At last a logistic regression on the two
views' log-odds, fitted on the labelled rows, calibrates and combines them,
and every document gets a score.

The features of all documents are written once as a slim table; the fits are
MLlib logistic regressions over it (partial sums per task, no row leaves the
executors), and scoring is plain arithmetic on columns.

Defined results: NULL texts count as empty, NULL sources and languages as '';
rows whose label is not 0 or 1 count as unlabelled, of several labels of one
document the smallest counts; with labels of one class only every document
gets that class's share (0.5 without labels); equal rows get equal scores, so
ties stay ties; a very long text is read whole; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, stored, table, words

# --- fixed values -----------------------------------------------------------
ROUNDS = 2
CONFIDENT = 0.95              # from this probability a pseudo-label is passed on
SOURCE_SLOTS, LANG_SLOTS = 32, 8
FOLDS, HELD_OUT = 4, 2        # crc32(id) mod FOLDS = HELD_OUT is never learnt
KEEP = 0.5
MAX_ITER, RIDGE = 25, 1e-3
# ---------------------------------------------------------------------------


def text_view(text: Column) -> list[Column]:
    """Content features; ``w`` (words) and ``ls`` (lines) are columns."""
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.greatest(F.size("ls"), F.lit(1)).cast("double")

    def rate(pattern: str, of: Column) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / of

    symbols, bangs = rate(r"[#*$%&|<>]+", n), (F.length(text) - F.length(
        F.replace(text, F.lit("!"), F.lit("")))) / n
    capitals = rate(r"[A-Z]+", chars)
    return [F.least(symbols, F.lit(3.0)), (symbols > 0.1).cast("double"), F.least(bangs, F.lit(3.0)),
            (bangs > 0.3).cast("double"), capitals, (capitals > 0.3).cast("double"),
            rate(r"[0-9]+", chars), F.size(F.array_distinct("w")) / n,
            1 - F.size(F.array_distinct("ls")) / lines, F.length(F.array_join("w", "")) / n / 10,
            F.log1p(n) / 10, (n < 20).cast("double")]


def meta_view(source: Column, lang: Column) -> list[Column]:
    s = F.pmod(F.xxhash64(source), F.lit(SOURCE_SLOTS))
    g = F.pmod(F.xxhash64(lang), F.lit(LANG_SLOTS))
    size, lines = F.log1p(F.col("n_chars")) / 10, F.log1p(F.size("ls")) / 10
    return ([size, size * size, lines, size - lines]
            + [(s == k).cast("double") for k in range(SOURCE_SLOTS)]
            + [(g == k).cast("double") for k in range(LANG_SLOTS)])


def features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str,
             lang_col: str, label_col: str) -> DataFrame:
    """id, t and m (the two views), y (0, 1 or NULL), learn."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                    F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                    F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    d = d.withColumns({"w": words("text"), "n_chars": F.length("text"), "ls": F.filter(
        F.split("text", "\n"), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")})
    slim = d.select("id", F.array(*text_view(F.col("text"))).alias("t"),
                    F.array(*meta_view(F.col("source"), F.col("lang"))).alias("m"))
    y = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
         .filter(F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y")))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return slim.join(y, "id", "left").withColumn("learn", F.col("y").isNotNull() & ~held)


def _fit(rows: DataFrame, view: str, label: str) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression on ``view``."""
    data = rows.select(array_to_vector(view).alias("features"),
                       F.col(label).cast("double").alias("label"))
    m = LogisticRegression(maxIter=MAX_ITER, regParam=RIDGE, family="binomial").fit(data)
    return float(m.intercept), [float(c) for c in m.coefficients.toArray()]


def _logit(view: str, model: tuple[float, Sequence[float]]) -> Column:
    b, w = model
    return F.aggregate(F.zip_with(F.col(view), F.array(*[F.lit(x) for x in w]), lambda x, y: x * y),
                       F.lit(float(b)), lambda a, x: a + x)


def _p(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def co_train(feats: DataFrame, rounds: int = ROUNDS) -> tuple | None:
    """Models of the text view, the metadata view and their combination, or
    None if the learnable labels lack a class."""
    known = {r["y"] for r in feats.filter("learn").select("y").distinct().collect()}
    if known != {0, 1}:
        return None
    base = feats.filter("learn").select("t", "m", "y")
    free = feats.filter(F.col("y").isNull())
    text, meta = _fit(base, "t", "y"), _fit(base, "m", "y")
    for _ in range(rounds):
        pt, pm = _p(_logit("t", text)), _p(_logit("m", meta))

        def sure(p: Column) -> DataFrame:
            return free.filter((p >= CONFIDENT) | (p <= 1 - CONFIDENT)).select(
                "t", "m", (p >= 0.5).cast("int").alias("y"))

        by_text, by_meta = sure(pt), sure(pm)
        text, meta = _fit(base.union(by_meta), "t", "y"), _fit(base.union(by_text), "m", "y")
    both = base.select("y", F.array(_logit("t", text), _logit("m", meta)).alias("z"))
    return text, meta, _fit(both, "z", "y")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                   label_col: str = "quality") -> DataFrame:
    """id, held_out, text_score, meta_score, score and keep of every document."""
    feats = stored(features(docs, labels, id_col, text_col, source_col, lang_col, label_col), "views")
    models = co_train(feats)
    held = F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    if models is None:
        share = feats.filter("learn").agg(F.avg("y").alias("s")).first()["s"]
        flat = F.lit(0.5 if share is None else float(share))
        cols = [flat.alias(c) for c in ("text_score", "meta_score", "score")]
    else:
        text, meta, mixed = models
        feats = feats.withColumns({"zt": _logit("t", text), "zm": _logit("m", meta)})
        feats = feats.withColumn("z", F.array("zt", "zm"))
        cols = [_p(F.col("zt")).alias("text_score"), _p(F.col("zm")).alias("meta_score"),
                _p(_logit("z", mixed)).alias("score")]
    out = feats.select(F.col("id").alias(id_col), held.alias("held_out"), *cols)
    return out.withColumn("keep", F.col("score") >= KEEP)


def op2_cotraining(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
