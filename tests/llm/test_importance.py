"""Importance resampling against a plain recount."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from tests.llm.conftest import edge_rows
from tickerlens.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, buckets, ngram, min_words, percent, seed):
    """(id, n_features, weight, score, rank) of every row, in the order drawn."""
    def feats(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = WORD.findall(t)
        return len(ws), Counter(crc32(" ".join(ws[i:i + n]).encode()) % buckets
                                for n in range(1, ngram + 1) for i in range(len(ws) - n + 1))
    docs = [(i, *feats(t)) for i, t in rows]
    s, t = sum((c for *_, c in docs), Counter()), sum((feats(x)[1] for x in target), Counter())
    ss, tt = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt))) for b in s}
    out = []
    for i, n_words, c in docs:
        n = c.total()
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, weight, score, n_words))
    able = sorted((x for x in out if x[4] >= min_words),
                  key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = Counter()
    ranks = {}
    for k, x in enumerate(able[:percent * len(able) // 100], 1):
        ranks.setdefault(x, []).append(k)
    res = []
    for x in out:
        drawn[x] += 1
        got = ranks.get(x, [])
        res.append((*x[:4], got.pop(0) if got else None))
    return res


def key(r):
    return tuple((x is None, x) for x in r)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])
                   for r in df.collect()), key=key)


def test_recount_with_runs_ties_and_repeated_rows(spark):
    rng = random.Random(8)
    vocab = [f"{a}{k}" for a in ("River", "x-", "ä", "9") for k in range(40)]
    rows = [(rng.randrange(120), " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for _ in range(200)]
    rows += [(7, "one two " * 700)] * 3 + [(None, "river " * 30), (None, None), (500, "")]
    target = [" ".join(rng.choices(vocab[:30], k=25)) for _ in range(20)] + [None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tg = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, ngram, min_words, percent in ((10_000, 1, 20, 10), (77, 2, 5, 50), (64, 3, 1, 100)):
        want = brute(rows, target, buckets, ngram, min_words, percent, 2024)
        have = got(I.importance_resample(df, tg, buckets=buckets, ngram=ngram, min_words=min_words,
                                         percent=percent))
        assert have == sorted(want, key=key)


def test_edges_empty_tables_and_clashing_columns(spark, edges, empty):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    none = spark.createDataFrame([], "text string")
    named = edges.withColumnsRenamed({"lang": "weight", "source": "__sketch", "__words": "__at"})
    out = I.importance_resample(named, none)
    assert got(out) == sorted(brute(rows, [], 10_000, 1, 20, 10, 2024), key=key)
    assert {r["__at"] for r in out.collect()} == {f"extra{i}" for i, *_ in edge_rows()}
    assert out.columns == ["doc_id", "__sketch", "n_chars", "__at", "n_words", "n_features", "weight",
                           "score", "rank"]
    assert I.importance_resample(empty, none).count() == 0
    short = spark.createDataFrame([(1, "too short")], "doc_id bigint, text string")
    assert [r["rank"] for r in I.importance_resample(short, none).collect()] == [None]


def test_bit_sliced_sums_equal_plain_sums():
    rng = np.random.default_rng(3)
    for buckets, top in ((64, 1), (130, 40), (10_000, 70_000)):
        gains = rng.integers(-top, top + 1, buckets)
        cells = np.unique(rng.integers(0, 30 * buckets, 900))
        n = rng.integers(1, 5000, len(cells))
        doc, at = cells // buckets, cells % buckets
        want = np.zeros(31, np.int64)
        np.add.at(want, doc, gains[at] * n)
        assert (I.sliced_sums(doc, at, n, 31, I.gain_planes(gains)) == want).all()
    none = np.zeros(0, np.int64)
    assert I.sliced_sums(none, none, none, 2, I.gain_planes(gains)).tolist() == [0, 0]
