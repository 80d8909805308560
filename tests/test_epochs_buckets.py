"""Epoch training equals plain NumPy, resumes where it stopped; bucketed
tables join without a shuffle."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tickerlens.operators import epochs as E
from tickerlens.sources import bucketed as B

PLAN = E.Plan(epochs=3, steps=8, rate=6.0, decay=0.001, width=64)


def corpus(n, seed):
    rng = random.Random(seed)
    words = {0: ["loss", "fall", "weak"], 1: ["flat", "same", "hold"], 2: ["gain", "rise", "strong"]}
    rows = []
    for i in range(n):
        label = rng.choice((0, 1, 1, 2))
        rows.append((i + seed * 10_000, " ".join(rng.choices(words[label] + ["the", "Market", "x"], k=6)), label))
    return rows


def number(s):
    return int(hashlib.sha256(s.encode()).hexdigest()[:8], 16)


def dense(rows, plan):
    x = np.zeros((len(rows), plan.width + 1))
    for k, (_, text, _) in enumerate(rows):
        x[k, 0] = 1.0
        for t in text.lower().split():
            x[k, 1 + number(t) % plan.width] += 1 / len(text.split())
    return x, np.array([r[2] for r in rows])


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain(rows, plan):
    """Weights and training loss of every epoch."""
    x, y = dense(rows, plan)
    step = np.array([number(f"step:{r[0]}") % plan.steps for r in rows])
    w, out = np.zeros((plan.width + 1, 3)), []
    for _ in range(plan.epochs):
        loss = 0.0
        for s in range(plan.steps):
            a, b = x[step == s], y[step == s]
            p = softmax(a @ w)
            loss -= np.log(p[np.arange(len(b)), b]).sum()
            p[np.arange(len(b)), b] -= 1
            w = w * (1 - plan.rate * plan.decay) - plan.rate * (a.T @ p) / max(len(b), 1)
        out.append((w, loss / len(rows)))
    return out


@pytest.fixture(scope="module")
def parts(spark):
    rows = [corpus(300, 1), corpus(80, 2)]
    return rows, [E.hashed_rows(spark.createDataFrame(r, "line_no bigint, sentence string, label int"), PLAN)
                  .repartition(3) for r in rows]


def test_epochs_equal_numpy(spark, parts, tmp_path):
    rows, (train, val) = parts
    weights, report = E.train_epochs(train, val, str(tmp_path), PLAN)
    want = plain(rows[0], PLAN)
    x, y = dense(rows[1], PLAN)
    got = {r["epoch"]: r for r in report.collect()}
    assert sorted(got) == [0, 1, 2]
    for k, (w, loss) in enumerate(want):
        assert np.allclose(E.load_weights(spark, str(tmp_path), k), w, atol=1e-10)
        assert abs(got[k]["loss"] - loss) < 1e-10
        assert abs(got[k]["val_accuracy"] - (softmax(x @ w).argmax(axis=1) == y).mean()) < 1e-12
    assert want[0][1] > want[1][1] > want[2][1] and got[2]["val_f1"] > 0.8
    best = max(got.values(), key=lambda r: (r["val_f1"], -r["epoch"]))["epoch"]
    assert [k for k, r in got.items() if r["best"]] == [best]
    assert np.allclose(weights, want[best][0], atol=1e-10)
    pred = E.predict(val, weights).toPandas()
    assert (pred["label"] == pred["prediction"]).mean() == got[best]["val_accuracy"]


def test_scorer_gives_the_logits_of_the_rows(spark, parts):
    from tickerlens.operators.scoring import score_in_pandas
    rows, (_, val) = parts
    for seed in (1, 2):                    # two models, one after the other, in the same workers
        w = np.random.default_rng(seed).normal(size=(PLAN.width + 1, 3))
        x, _ = dense(rows[1], PLAN)
        df = spark.createDataFrame([(str(r[0]), r[1]) for r in rows[1]] + [("blank", " "), ("none", None)],
                                   "headline_hash string, headline string")
        got = {r["headline_hash"]: (r["sentiment_label"], r["confidence"])
               for r in score_in_pandas(df, E.EpochScorer(w)).collect()}
        p = softmax(x @ w)
        names = ["negative", "neutral", "positive"]
        for k, r in enumerate(rows[1]):
            assert got[str(r[0])][0] == names[p[k].argmax()] and abs(got[str(r[0])][1] - p[k].max()) < 1e-12
        assert got["blank"] == got["none"] == (names[w[0].argmax()], pytest.approx(softmax(w[:1]).max()))


def test_training_resumes_after_the_last_finished_epoch(spark, parts, tmp_path, monkeypatch):
    _, (train, val) = parts
    whole, _ = E.train_epochs(train, val, f"{tmp_path}/whole", PLAN)
    calls = []
    real = E.gradient

    def stops(rows, weights):
        calls.append(1)
        if len(calls) == 11:                  # in the second epoch
            raise RuntimeError("lost")
        return real(rows, weights)
    monkeypatch.setattr(E, "gradient", stops)
    with pytest.raises(RuntimeError):
        E.train_epochs(train, val, f"{tmp_path}/parts", PLAN)
    assert [r["epoch"] for r in E.finished(spark, f"{tmp_path}/parts", 3)] == [0]
    weights, report = E.train_epochs(train, val, f"{tmp_path}/parts", PLAN)
    assert len(calls) == 11 + 2 * PLAN.steps and report.count() == 3
    assert np.allclose(weights, whole, atol=1e-10)
    E.train_epochs(train, val, f"{tmp_path}/parts", PLAN)
    assert len(calls) == 11 + 2 * PLAN.steps  # nothing is trained twice


def test_empty_training_set(spark, tmp_path):
    none = E.hashed_rows(spark.createDataFrame([], "line_no bigint, sentence string, label int"), PLAN)
    weights, report = E.train_epochs(none, none, str(tmp_path), E.Plan(epochs=1, steps=1, width=8))
    assert not weights.any() and report.first()["val_f1"] is None


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    from tickerlens.operators import analytics as A
    from tickerlens.plans import common as C
    daily, returns = C.daily(spark, SF_SMALL), C.returns(spark, SF_SMALL)
    name = f"t{abs(hash(str(tmp_path)))}"
    left, right = B.index_sessions(daily, returns, name, str(tmp_path), buckets=6)
    joined = B.indexed_join(left, right)
    p = plan(joined)
    assert "SortMergeJoin" in p and "Exchange" not in p and p.count("SelectedBucketsCount: 6 out of 6") == 2
    want = A.sentiment_price_join(daily, returns)
    assert "Exchange" in plan(want)
    cols = joined.columns
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, want.select(cols).collect()))
    one = right.filter("ticker = 'T01' AND market_date = DATE'2024-01-16'")     # a look-up reads one bucket
    assert one.count() == returns.filter("ticker = 'T01' AND market_date = DATE'2024-01-16'").count()
    assert B.open_bucketed(spark, f"{name}_bars") is not None and B.open_bucketed(spark, "absent_table") is None
    again = B.write_bucketed(daily, f"{name}_daily", f"{tmp_path}/daily", buckets=6)     # replaced
    assert again.count() == daily.count()
