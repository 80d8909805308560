"""Stored tables: only the touched partitions are read, replays replace
themselves, counters come from the passes that write."""

import datetime as dt
import inspect
import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_streaming import bars, land, ledger, run_news
from tickerlens.operators.prices import price_window
from tickerlens.sources.tables import stream_schema
from tickerlens.streaming import jobs as R
from tickerlens.streaming import stores as S

KEYS = ("headline_hash",)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def partitions_read(df) -> int:
    """Partitions that the file scan of an executed plan opened."""
    node = df._jdf.queryExecution().executedPlan()
    df.collect()
    todo = [node]
    while todo:
        n = todo.pop()
        if n.nodeName() == "AdaptiveSparkPlan":
            todo.append(n.executedPlan())
            continue
        if n.nodeName().startswith("Scan parquet"):
            return n.metrics().apply("numPartitions").value()
        todo += [n.children().apply(i) for i in range(n.children().size())]
    raise AssertionError("no scan")


def test_key_lookup_reads_the_prefixes_of_the_batch(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/in", [f"headline {k}" for k in range(200)])
    R.start_headlines(spark, f"{base}/in", f"{base}/h", f"{base}/c1", as_of="2024-02-01", digits=2).awaitTermination()
    stored = spark.read.parquet(f"{base}/h")
    prefixes = sorted(r[0] for r in stored.select(S.prefix_of("headline_hash", 2)).distinct().collect())
    assert len(prefixes) > 50
    some = S.stored_keys(spark, f"{base}/h", KEYS, prefixes[:3], "another", 0, 2)
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#\d+ IN ", plan(some))
    assert partitions_read(some) == 3
    want = {r[0] for r in stored.select("headline_hash").collect() if r[0][:2] in prefixes[:3]}
    assert {r["headline_hash"] for r in some.collect()} == want
    # the batch's own partition is never looked up
    run = stored.first()["run"]
    assert S.stored_keys(spark, f"{base}/h", KEYS, prefixes, run, 0, 2).count() == 0
    # other digits: the keys are dealt anew from the table
    dealt = S.stored_keys(spark, f"{base}/h", KEYS, ["0", "f"], "another", 0, 1)
    assert dealt.count() == stored.filter("substring(headline_hash, 1, 1) IN ('0', 'f')").count()
    assert partitions_read(dealt) == 2


def test_keys_equal_the_table_after_replay_and_when_made_later(spark, tmp_path):
    base = str(tmp_path)
    body = R.headline_batch(f"{base}/h", "2024-02-01")
    land(spark, f"{base}/in", ["one", "two", "two"])
    batch = spark.read.schema(R.FEED_FILE_SCHEMA).json(f"{base}/in")
    for _ in range(2):                                   # a replay of the same micro-batch
        assert body(batch, "run1", 0) == S.Counts(2, 1, 0, dt.datetime(2024, 1, 2, 10))
    assert body(batch, "run1", 1).inserted == 0

    def same():
        t = sorted(r[0] for r in spark.read.parquet(f"{base}/h").select("headline_hash").collect())
        k = sorted(r[0] for r in S.open_keys(spark, f"{base}/h", KEYS).select("headline_hash").collect())
        return t == k and len(t) == 2
    assert same()
    # a table written without keys gets them when it is opened
    other = f"{base}/old"
    spark.read.parquet(f"{base}/h").write.partitionBy("run", "batch_no").parquet(other)
    assert R.headline_batch(other, "2024-02-01")(batch, "run2", 0).inserted == 0


def test_two_keys(spark, tmp_path):
    base = str(tmp_path)
    keys = ("ticker", "headline_hash")
    arts = [("same", None, "2024-01-02T10:00:00Z", (None,))]
    batch = spark.createDataFrame([(arts, "T00", 0, 0, 0), (arts, "T01", 1, 0, 0)], R.FEED_FILE_SCHEMA)
    body = R.headline_batch(f"{base}/h", "2024-02-01", keys)
    assert body(batch, "a", 0).inserted == 2 and body(batch, "b", 0) == S.Counts(0, 2, 0, dt.datetime(2024, 1, 2, 10))


def test_price_lookup_reads_the_dates_of_the_batch(spark, tmp_path):
    base = str(tmp_path)
    bars(spark, f"{base}/in", [(1, d, 10.0 + d) for d in range(1, 21)])
    R.start_prices(spark, f"{base}/in", f"{base}/p", f"{base}/c", f"{base}/log").awaitTermination()
    bars(spark, f"{base}/in", [(2, 20, 99.0), (2, 21, 31.0), (2, 22, float("nan"))])
    R.start_prices(spark, f"{base}/in", f"{base}/p", f"{base}/c", f"{base}/log").awaitTermination()
    assert ledger(spark, base) == [(1, 1, None), (20, 0, None)]
    got = {r["market_date"].day: r["close"] for r in spark.read.parquet(f"{base}/p").collect()}
    assert got[20] == 30.0 and got[21] == 31.0 and len(got) == 21
    known = S.stored_prices(spark, f"{base}/p", [dt.date(2024, 1, 20), dt.date(2024, 1, 21)])
    assert re.search(r"PartitionFilters: \[[^\]]*market_date#\d+ IN ", plan(known))
    assert partitions_read(known) == 2


def test_price_window_reads_its_dates_from_the_store(spark, tmp_path):
    from tickerlens.plans import common as C
    stored = S.write_prices(C.returns(spark, SF_SMALL), f"{tmp_path}/p")
    w = price_window(stored, C.PRICE_AS_OF)
    assert "PartitionFilters: [isnotnull(market_date" in plan(w)
    assert partitions_read(w) == w.select("market_date").distinct().count() < \
        stored.select("market_date").distinct().count()
    again = S.write_prices(C.returns(spark, SF_SMALL), f"{tmp_path}/p")       # replaces itself
    assert again.count() == C.returns(spark, SF_SMALL).count()


def test_late_rows_are_stored_and_counted(spark, tmp_path):
    base = str(tmp_path)

    def land_at(titles, day, batch):
        arts = [(t, None, f"2024-01-{day:02d}T10:00:00Z", (None,)) for t in titles]
        arts.append((f"no time {batch}", None, None, (None,)))
        spark.createDataFrame([(arts, "T00", 0, batch, 0)], R.FEED_FILE_SCHEMA).write.mode("append").json(f"{base}/in")
    land_at(["new"], 20, 0)
    run_news(spark, base, "c")
    land_at(["old", "older"], 12, 1)
    run_news(spark, base, "c")
    land_at(["week", "within"], 13, 2)
    assert run_news(spark, base, "c") == ["new", "no time 0", "no time 1", "no time 2", "old", "older",
                                          "week", "within"]
    rows = {r["batch_no"]: (r["inserted"], r["late"], r["newest"].day)
            for r in R.read_ledger(spark, f"{base}/log").collect()}
    assert rows == {0: (2, 0, 20), 1: (3, 2, 12), 2: (3, 0, 13)}


def test_no_pass_only_counts():
    src = inspect.getsource(R) + inspect.getsource(S)
    assert ".count()" not in src and "persist(" not in src


def test_scorer_opens_the_backlog_only(spark):
    from tickerlens.sources import driver
    every = driver.model_outputs(spark, SF_SMALL)
    some = every.select("headline_hash").distinct().orderBy("headline_hash").limit(20)
    got = driver.model_outputs(spark, SF_SMALL, some)
    first = every.join(some, "headline_hash", "left_semi").groupBy("headline_hash").agg(F.min("doc_id").alias("doc_id"))
    want = every.join(first, ["headline_hash", "doc_id"])
    cols = ["doc_id", "window", "headline_hash", "logits", "tokens", "attention", "length"]
    key = repr
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want.select(cols).collect()))
    assert stream_schema("scores")["run"].dataType.simpleString() == "string"
