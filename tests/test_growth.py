"""What grows with the tables is moved or parsed once, with the same rows."""

import glob
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerlens.functions.text import split_last, ustrip
from tickerlens.llm import bpe
from tickerlens.llm.queries import ORACLES
from tickerlens.operators import epochs as E
from tickerlens.operators import ml as M
from tickerlens.operators.ingest import first_arrivals
from tickerlens.operators.rank import distributed_rank
from tickerlens.plans import catalog as C
from tickerlens.sources import driver, feeds
from tickerlens.streaming import jobs, stores


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def articles(spark, n=400):
    rows = [(f"t{i}", f"u{i}", None if i % 9 == 0 else f"2024-01-{1 + i % 3:02d}T10:{i % 60:02d}:00Z", None,
             None if i % 50 == 7 else f"T{i % 3:02d}", i % 3, i % 2, i) for i in range(n)]
    return spark.createDataFrame(rows, "title string, url string, published_at string, source_name string, "
                                       "ticker string, ticker_pos int, batch_id bigint, feed_rank bigint")


def pages_in_python(rows, size):
    groups = {}
    for r in rows:
        groups.setdefault((r["ticker"], r["batch_id"]), []).append(r)
    out = {}
    for (t, b), rs in groups.items():
        rs.sort(key=lambda r: r["feed_rank"])
        rs.sort(key=lambda r: r["published_at"] or "", reverse=True)
        for rk, r in enumerate(rs):
            out.setdefault((t, r["ticker_pos"], b, rk // size), []).append(r["title"])
    return out


@pytest.mark.parametrize("bound", [10_000, 100, 0])
def test_pages_are_the_same_by_group_and_by_cell(spark, monkeypatch, bound):
    monkeypatch.setattr(feeds, "GROUP_ROWS", bound)
    arts = articles(spark)
    got = feeds.parse_feed(feeds.build_feed_pages(arts, 7)).collect()
    found = {(r["ticker"], r["ticker_pos"], r["batch_id"], r["page"]): [a["title"] for a in r["articles"]] for r in got}
    assert len(got) == len(found)
    assert found == pages_in_python(arts.collect(), 7)


def test_cells_shuffle_the_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("c"),
                                  "id", F.lit("payload").alias("p"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = distributed_rank(df, ["g"], F.col("c"), [F.col("c").asc_nulls_last(), F.col("id")])
        # rows, counts, offsets by group, offsets by cell; and no second one for the rows
        assert plan_of(ranked).count("Exchange hashpartitioning") == 4
        got = {r["id"]: r["rank"] for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for g in range(3):
        ids = sorted((i for i in range(1000) if i % 3 == g), key=lambda i: (i % 5 or 9, i))
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_texts_are_joined_by_one_key(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "en", "a\nb"), (2, "en", "c"), (3, "en", "d"), (4, "en", "e"), (None, "en", "f"),
                           (2, "de", "g"), (-2, "en", "h")], "doc_id bigint, lang string, text string"
                          ).write.parquet(f"{sf}/documents.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-02 10:00:00' + make_dt_interval(0, 0, 0, id) AS ts "
              "FROM VALUES (5L), (10L), (10L), (11L), (4L), (-10L), (CAST(NULL AS BIGINT)) t(id)"
              ).write.parquet(f"{sf}/events.parquet")
    spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "n"), (9, "w")], "page_id bigint, url string"
                          ).write.parquet(f"{sf}/pages.parquet")
    rows = driver.article_rows(spark, sf)
    got = sorted((r["title"], r["url"] or "", r["published_at"] or "") for r in rows.collect())
    at = "2024-01-02T10:00:{:02d}Z".format
    assert got == sorted([("a", "", at(5)), ("b", "", at(5)), *[(t, u, at(10)) for t in "cg" for u in "xxyy"],
                          ("d", "z", ""), ("e", "", ""), ("f", "", ""), ("h", "", "2024-01-02T09:59:50Z")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(driver.article_rows(spark, sf)).count("hashpartitioning(doc_id") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_staged_rows_are_compressed_well(spark, tmp_path):
    rows, seen = stores.staged(spark.range(10), f"{tmp_path}/s", top=F.max("id"))
    assert seen["n"] == 10 and rows.count() == 10
    assert all("zstd" in f for f in glob.glob(f"{tmp_path}/s/*.parquet"))


def test_strip_and_split_need_no_regular_expression(spark):
    df = spark.createDataFrame([(" 　a @b\x1c@ c\u0085\n",), ("@",), ("x",), ("",), (" ",), (None,), ("é@\U0001F600@ü ",)],
                               "v string")
    b, a = split_last("v")
    out = df.select(ustrip("v").alias("s"), b.alias("b"), a.alias("a"), "v")
    assert "regexp" not in plan_of(out)
    for s, before, after, v in out.collect():
        assert s == (None if v is None else v.strip())
        assert (before, after) == (tuple(v.rsplit("@", 1)) if v and "@" in v else (None, None))


def test_long_line_is_hashed_in_linear_time(spark):
    plan = E.Plan(width=1 << 13)
    words = [f"w{i}" for i in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "B b a")], "line_no long, sentence string")
    rows = E.hashed_rows(df, plan)
    assert "filter(hits" not in plan_of(rows).replace(" ", "")
    got = {r["line_no"]: r for r in rows.collect()}

    def bucket(w):
        return int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % plan.width
    want = sorted({bucket(w) for w in words})
    assert got[1]["buckets"] == [-1, *want] and abs(sum(got[1]["shares"]) - 2) < 1e-9
    assert (got[2]["buckets"], got[2]["shares"]) == ([-1], [1.0])
    assert (got[3]["buckets"], got[3]["shares"]) == (None, None)
    pairs = sorted([(bucket("a"), 1 / 3), (bucket("b"), 2 / 3)])
    assert got[4]["buckets"] == [-1, *[b for b, _ in pairs]] and got[4]["shares"] == [1.0, *[s for _, s in pairs]]


def test_stored_rows_train_the_same(spark, tmp_path):
    plan = E.Plan(epochs=2, steps=3, width=32)
    df = spark.createDataFrame([(i, f"w{i % 5} v{i % 7}", i % 3) for i in range(120)],
                               "line_no long, sentence string, label int")
    rows = E.hashed_rows(df, plan)
    late = F.col("line_no") >= 90
    w, report = E.train_epochs(rows.filter(~late), rows.filter(late), f"{tmp_path}/a", plan)
    kept = E.store_rows(rows, f"{tmp_path}/b/stored", F.when(late, "validation").otherwise("train"))
    w2, report2 = E.train_epochs(kept.filter("subset = 'train'"), kept.filter("subset = 'validation'"),
                                 f"{tmp_path}/b", plan, stored=True)
    assert np.allclose(w, w2)
    assert not glob.glob(f"{tmp_path}/b/rows")
    assert [r["best"] for r in report.collect()] == [r["best"] for r in report2.collect()]


def test_best_token_of_every_row():
    coef = np.array([[1.0, 2, 3], [3, 3, 1]])
    got = M._best_tokens(coef, pa.array([0, 1, 1, 0], pa.int32()),
                         pa.array([["a", "b"], ["x", "y", "z"], [], None], pa.list_(pa.string())),
                         pa.array([[0, 2], [2, 0, 1], [], None], pa.list_(pa.int32()))).to_pylist()
    assert [(r["tok"], r["neg_pos"]) for r in got] == [("b", -1), ("y", -1), (None, None), (None, None)]


def test_winners_carry_what_is_asked(spark):
    rows = [(h, "T00", t, "s", "raw", 0, 0, k) for k, (h, t) in enumerate([("h", "late"), ("h", "x"), ("g", "y")])]
    df = spark.createDataFrame(rows, "headline_hash string, ticker string, headline string, source string, "
                                     "raw_timestamp string, batch_id long, ticker_pos int, feed_rank long")
    out = first_arrivals(df, carry=("headline",))
    assert out.columns == ["headline_hash", "headline"]
    assert sorted(map(tuple, out.collect())) == [("g", "y"), ("h", "late")]


def test_pieces_of_a_slice_are_remembered(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 257}
    codec = bpe.Codec(ranks, r" ?\p{L}+|\s+")
    monkeypatch.setattr(bpe, "CACHE_PIECES", 1)
    texts = ["ab ab abc", None, "", "ab" + "c" * 100, "é ab"]
    for _ in range(3):
        packed = list(codec.encode_all(texts))
        assert [codec.decode(p) for p in packed] == [(t or "").encode() for t in texts]
        assert codec.encode("ab ab abc") == packed[0]
    assert all(len(p) <= bpe.CACHE_KEY_CHARS for p in [*codec.known, *codec.older])


def test_sql_of_every_oracle_is_text():
    assert all(isinstance(s, str) for s in ORACLES.values())


def doc_rows(spark, n=60):
    rows = [(i, "en", None if i % 13 == 5 else "\n".join(f"d{i} l{k}" for k in range(i % 4 + 1)), f"T{i % 3:02d}", i % 3,
             f"u{i}", None if i % 9 == 0 else f"2024-01-{1 + i % 3:02d}T10:{i % 7:02d}:00Z", i % 2) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, ticker string, ticker_pos int, url string, "
                                       "published_at string, batch_id long")
    return docs.withColumns({"published_raw": F.lit(None).cast("timestamp_ntz"),
                             "n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0))})


@pytest.mark.parametrize("bound", [10_000, 22, 0])
def test_documents_give_the_pages_of_their_lines(spark, monkeypatch, bound):
    monkeypatch.setattr(feeds, "GROUP_ROWS", bound)
    docs = doc_rows(spark)
    got = feeds.build_feed_pages(docs, 5, opened=driver.open_articles, n_rows=F.col("n_lines"))
    found = {(r["ticker"], r["ticker_pos"], r["batch_id"], r["page"]): [a["title"] for a in r["articles"]]
             for r in feeds.parse_feed(got).collect()}
    assert found == pages_in_python(driver.open_articles(docs).collect(), 5)


def test_groups_are_measured_without_their_texts(spark, tmp_path):
    sf = str(tmp_path)
    spark.sql("SELECT id AS doc_id, 'en' AS lang, concat('a', id, char(10), 'b') AS text FROM range(40)"
              ).write.parquet(f"{sf}/documents.parquet")
    spark.sql("SELECT id * 5 AS event_id, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS ts FROM range(40)"
              ).write.parquet(f"{sf}/events.parquet")
    spark.sql("SELECT id AS page_id, 'u' AS url FROM range(40)").write.parquet(f"{sf}/pages.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = C._feed_pages(spark, sf)
        tree = plan_of(pages)
        assert sum(a["title"][0] in "ab" for r in feeds.parse_feed(pages).collect() for a in r["articles"]) == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the sizes of groups come from counted lines; documents are moved by group
    # and opened after that
    assert "sum(n_lines" in tree
    lines = tree.splitlines()
    by_group = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(ticker" in x and "REPARTITION_BY_COL" in x)
    assert any("Generate posexplode" in x for x in lines[:by_group])


def test_both_runs_are_landed_from_one_write(spark, tmp_path):
    base = str(tmp_path)
    row = ([("t", "u", "2024-01-02T10:00:00Z", (None,))], "T00", 0, 7, 0)
    (spark.createDataFrame([row], jobs.FEED_FILE_SCHEMA).withColumn("first", F.lit(True))
     .write.option("compression", "gzip").partitionBy("first").json(f"{base}/out"))
    for n, first in enumerate((True, False), 1):         # nothing was written for the second run
        C._land_feeds(spark, base, first)
        assert len(glob.glob(f"{base}/in/*.json*")) == n
        jobs.start_headlines(spark, f"{base}/in", f"{base}/h", f"{base}/c", f"{base}/log",
                             as_of="2024-02-01").awaitTermination()
    log = jobs.read_ledger(spark, f"{base}/log").orderBy("batch_no")
    assert [tuple(r) for r in log.select("inserted", "skipped").collect()] == [(1, 0), (0, 0)]


def test_only_keys_are_staged(spark, tmp_path):
    row = ([(t, None, "2024-01-02T10:00:00Z", (None,)) for t in ("one", "two", "one")], "T00", 0, 0, 0)
    batch = spark.createDataFrame([row], jobs.FEED_FILE_SCHEMA)
    for body in (jobs.headline_batch(f"{tmp_path}/h", "2024-02-01"), jobs.bounded_batch(f"{tmp_path}/b", "2024-02-01")):
        assert (body(batch, "r", 0).inserted, body(batch, "r", 1).inserted) == (2, 0)
    for t in ("h", "b"):
        staged = spark.read.parquet(f"{tmp_path}/{t}_staging/r")
        assert "headline" not in staged.columns and dict(staged.dtypes)["headline_hash"] == "binary"
        stored = spark.read.parquet(f"{tmp_path}/{t}").select("headline", "headline_hash").collect()
        assert sorted(stored) == sorted((x, hashlib.sha256(x.encode()).hexdigest()) for x in ("one", "two"))


def test_a_first_run_looks_nothing_up(spark, tmp_path, monkeypatch):
    calls = []
    real = jobs.not_stored
    monkeypatch.setattr(jobs, "not_stored", lambda *a: calls.append(1) or real(*a))
    row = ([(t, None, "2024-01-02T10:00:00Z", (None,)) for t in ("one", "two", "one")], "T00", 0, 0, 0)
    batch = spark.createDataFrame([row], jobs.FEED_FILE_SCHEMA)
    table = f"{tmp_path}/h"
    jobs.headline_batch(table, "2024-02-01")(batch, "r", 0)

    def scorer(backlog):
        return backlog.select("headline_hash", F.lit("neutral").alias("sentiment_label"), F.lit(1.0).alias("confidence"),
                              F.lit(None).cast("string").alias("attention_keyword"), F.lit("m").alias("model_version"))
    body = jobs.scoring_batch(table, f"{tmp_path}/s", scorer)
    assert [(body(batch, "s", n).inserted, len(calls)) for n in range(2)] == [(2, 0), (0, 1)]
    winners = spark.createDataFrame([(bytearray(b"a"), 1)], "headline_hash binary, n int")
    none = spark.createDataFrame([], "headline_hash string")
    assert stores.unseen(winners, winners, none, ["headline_hash"]) is winners


def test_times_of_winners_are_those_of_records(spark):
    arts = [(t, None, ts, (None,)) for t, ts in (("one", "2024-01-05T23:30:00Z"), ("two", None), ("three", "no time"))]
    batch = spark.createDataFrame([(arts, "T00", 0, 0, 0)], jobs.FEED_FILE_SCHEMA)
    recs = jobs.batch_records(batch, "2024-02-01")
    won = jobs.hex_hash(jobs.batch_winners(recs, "2024-02-01", ["headline_hash"]))
    cols = sorted(recs.columns)
    assert sorted(won.columns) == cols
    assert sorted(map(str, won.select(cols).collect())) == sorted(map(str, recs.select(cols).collect()))
    shuffled = plan_of(won).split("Exchange")[1]
    assert "session" not in shuffled and "market_date" not in shuffled.splitlines()[1]
