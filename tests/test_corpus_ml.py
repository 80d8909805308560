"""Corpus parse, exact stratified split, metrics (FIXTURES 2.9, 2.11, 2.13)."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from pyspark.sql import functions as F

from tickerlens.operators.corpus import (corpus_audit, parse_corpus, read_corpus, split_quotas,
                                         stratified_split)
from tickerlens.operators.ml import macro_metrics


def test_corpus_file_iso_8859_1(spark):
    d = tempfile.mkdtemp(prefix="corpus-")
    p = os.path.join(d, "c.txt")
    lines = [b"Profit rose@positive", b"Mail a@b.com now@ Neutral ", b"@negative",
             b"caf\xe9 up@positive", b"no label here", b"", b"odd@mixed"]
    with open(p, "wb") as f:
        f.write(b"\n".join(lines) + b"\n")
    lines_df = read_corpus(spark, p)
    rows = sorted((r.sentence, r.label) for r in parse_corpus(lines_df).collect())
    assert rows == sorted([("Profit rose", 2), ("Mail a@b.com now", 1), ("", 0), ("café up", 2)])
    a = corpus_audit(lines_df).first()
    assert (a.n_blank, a.n_no_delimiter, a.n_unknown_label, a.n_rows) == (1, 1, 1, 4)


def _labelled(spark, counts):
    rows, i = [], 0
    for lab, n in enumerate(counts):
        for _ in range(n):
            rows.append((i, f"s{i}", lab))
            i += 1
    return spark.createDataFrame(rows, "line_no long, sentence string, label int")


def test_split_quotas_golden(spark):
    df = _labelled(spark, [20, 30, 50])
    q = {r.label: (r.n_train, r.n_validation, r.n_test) for r in split_quotas(df).collect()}
    assert [q[i][0] for i in range(3)] == [14, 21, 35]
    assert sum(q[i][1] for i in range(3)) == 15 and sum(q[i][2] for i in range(3)) == 15
    assert [q[i][1] + q[i][2] for i in range(3)] == [6, 9, 15]
    s = stratified_split(df)
    got = {(r.split, r.label): r["count"] for r in s.groupBy("split", "label").count().collect()}
    for lab in range(3):
        assert got[("train", lab)] == q[lab][0]
        assert got.get(("validation", lab), 0) == q[lab][1]


def test_split_exact_at_scale_and_deterministic(spark):
    df = spark.range(0, 20003).select(F.col("id").alias("line_no"),
                                      F.concat(F.lit("s"), (F.col("id") % 997).cast("string")).alias("sentence"),
                                      (F.col("id") % 3 == 0).cast("int").alias("label"))
    s1 = stratified_split(df).groupBy("split", "label").count().collect()
    q = {r.label: r for r in split_quotas(df).collect()}
    for r in s1:
        want = {"train": q[r.label].n_train, "validation": q[r.label].n_validation,
                "test": q[r.label].n_test}[r.split]
        assert r["count"] == want
    a = stratified_split(df).filter(F.col("split") == "test").select("line_no")
    b = stratified_split(df).filter(F.col("split") == "test").select("line_no")
    assert a.exceptAll(b).count() == 0


def test_macro_metrics_golden(spark):
    df = spark.createDataFrame(list(zip([0, 1, 2, 2], [1, 1, 2, 1])), "label int, prediction int")
    m = macro_metrics(df).first()
    assert math.isclose(m.accuracy, 0.5)
    assert math.isclose(m.precision, 4 / 9)
    assert math.isclose(m.recall, 0.5)
    assert math.isclose(m.f1, 7 / 18)


def test_split_does_not_depend_on_the_reading(spark):
    rows = [(i, f"s {i % 900}", i % 3) for i in range(1500)]
    a = spark.createDataFrame(rows, "line_no bigint, sentence string, label int")
    b = a.withColumn("line_no", 10_000 - F.col("line_no")).repartition(7)
    one, two = (sorted((r["split"], r["label"], r["sentence"]) for r in stratified_split(d).collect())
                for d in (a, b))
    assert one == two
    odd = spark.createDataFrame([(1, "x", 9), (2, "y", None)], a.schema)
    assert [r["split"] for r in stratified_split(a.union(odd)).filter("label = 9 or label is null").collect()] \
        == [None, None]


def test_model_saved_loaded_and_missing(spark, tmp_path):
    from tickerlens.operators import ml
    from tickerlens.operators.scoring import score_with_pipeline
    rows = [(f"good profit {i}", 2) for i in range(30)] + [(f"bad loss {i}", 0) for i in range(30)] \
        + [(f"plain day {i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "sentence string, label int")
    model, _ = ml.train_select(df, df, grid=({"reg_param": 0.01},), width=512)
    path = str(tmp_path / "m")
    assert ml.load_model(spark, path) is None
    version = ml.save_model(model, path)
    again = ml.load_model(spark, path)
    todo = spark.createDataFrame([("h1", "good profit never seen"), ("h2", ""), ("h3", "unseen words only")],
                                 "headline_hash string, headline string")
    got = {r["headline_hash"]: r for r in score_with_pipeline(todo, again, ml.model_version(again)).collect()}
    assert got["h1"]["sentiment_label"] == "positive" and got["h1"]["model_version"] == version
    assert got["h1"]["attention_keyword"] in ("good", "profit")
    assert got["h2"]["attention_keyword"] is None and got["h3"]["attention_keyword"] is not None
