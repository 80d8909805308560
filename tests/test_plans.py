"""Plan checks: pushdown, no Python in SQL-expressible plans, no cartesian
products, partial aggregation for dedup."""

import pytest

from tests.conftest import SF_SMALL

from __spark_entry__ import queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
NATIVE = ["log_return", "ohlcv_bars", "headline_dedup", "score_merge", "daily_sentiment",
          "rolling_pearson", "event_study", "feed_topk", "topic_match", "stratified_split",
          "attention_keyword", "keyword_stopwords", "logits_decode", "corpus_parse"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cartesian(spark, name):
    p = plan(queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), name
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_column_pruning_reaches_scan(spark):
    df = queries()["ohlcv_bars"](spark, SF_SMALL)
    p = plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in p
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]


def test_pushed_filter_on_price_cut(spark):
    from pyspark.sql import functions as F
    from tickerlens.sources import driver
    t = driver.ticks(spark, SF_SMALL).filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in plan(t)


def test_dedup_is_partial_aggregate(spark):
    p = plan(queries()["headline_dedup"](spark, SF_SMALL))
    assert "partial_min_by" in p


def test_topk_uses_window_group_limit(spark):
    p = plan(queries()["feed_topk"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


SIDE_EFFECTS = ("stream_", "train_", "scoring_drain", "split_roundtrip")


def _nodes(p):
    """All physical nodes of a plan (the AQE wrapper is unwrapped)."""
    if p.nodeName() == "AdaptiveSparkPlan":
        p = p.inputPlan()
    out, stack = [], [p]
    while stack:
        n = stack.pop()
        out.append(n)
        kids = n.children()
        stack.extend(kids.apply(i) for i in range(kids.size()))
    return out


@pytest.mark.parametrize("name", sorted(k for k in queries() if not k.startswith(SIDE_EFFECTS)))
def test_no_single_partition_window_or_pairs(spark, name):
    """Every window is partitioned, and no plan pairs all rows of two sides."""
    nodes = _nodes(queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan())
    names = [n.nodeName() for n in nodes]
    assert "CartesianProduct" not in names and "BroadcastNestedLoopJoin" not in names, name
    for n in nodes:
        if n.nodeName() == "Window":
            assert not n.partitionSpec().isEmpty(), (name, n.toString())


def test_plan_check_catches_single_partition_window_and_pairs(spark):
    """Negative control for the check above."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10)
    bad = df.withColumn("r", F.row_number().over(Window.orderBy("id")))
    wins = [n for n in _nodes(bad._jdf.queryExecution().executedPlan()) if n.nodeName() == "Window"]
    assert wins and wins[0].partitionSpec().isEmpty()
    pairs = df.crossJoin(spark.range(3).withColumnRenamed("id", "j"))
    names = [n.nodeName() for n in _nodes(pairs._jdf.queryExecution().executedPlan())]
    assert "BroadcastNestedLoopJoin" in names or "CartesianProduct" in names
