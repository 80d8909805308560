"""Edge rows and brute force for the operators on documents."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import LONG, ORDINARY, PASSAGE, edge_rows
from tickerlens.llm import bpe, debruijn, decontam, jaccard_orders, line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], r)
    return out


# ---------------------------------------------------------- quality rules ----

def repeat_words(ws, k=8):
    at = {}
    for i in range(len(ws) - k + 1):
        at.setdefault(tuple(ws[i:i + k]), []).append(i)
    gone = {i + j for s in at.values() if len(s) > 1 for i in s for j in range(k)}
    return len(gone)


def test_quality_stats_and_order(spark, edges):
    got = by_id(quality_rules.quality_cascade(edges, with_stats=quality_rules.BASE_STATS,
                                              failed_col="why"))
    for i, t, *_ in edge_rows():
        ws = WORD.findall(t or "")
        r = got[i]
        assert r["n_words"] == len(ws)
        assert r["word_chars"] == sum(map(len, ws))
        assert r["n_repeat_words"] == repeat_words(ws)
        assert r["__words"] == f"extra{i}"
        assert r["kept"] == (r["why"] is None)
    assert got[4]["kept"] and not got[0]["kept"] and not got[10]["kept"]
    verdict = {i: r["kept"] for i, r in got.items()}
    for order in itertools.permutations(quality_rules.RULES[:3]):
        order = [*order, *quality_rules.RULES[3:]]
        again = by_id(quality_rules.quality_cascade(edges, order=order))
        assert {i: r["kept"] for i, r in again.items()} == verdict
    only = quality_rules.quality_cascade(edges, kept_only=True)
    assert only.count() == sum(verdict[r[0]] for r in edge_rows())


def test_quality_rule_order_is_by_rejections_per_cost(spark):
    rows = [(i, "x! " * 30 if i % 2 else ORDINARY) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = quality_rules.rule_order(df, fraction=1.0)
    assert order[0][0].name == "shouting" and order[0][1] == 0.5
    rates = [share / cost for _, share, cost in order]
    assert rates == sorted(rates, reverse=True)


def test_empty_tables(spark, empty):
    assert quality_rules.quality_cascade(empty).count() == 0
    assert line_dedup.drop_site_lines(empty, empty["source"]).count() == 0
    assert debruijn.remove_repeats(empty).count() == 0
    assert jaccard_orders.link_classes(empty).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.benchmark_leaks(empty, items).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------- line dedup ----

def test_line_dedup_ratio_copies_and_edges(spark, edges):
    rows = [(i, f"Menu\nbody {i}\n Menu ", "a") for i in range(10)]
    rows += [(100 + i, "same page\nall of it", "b") for i in range(20)]       # copies: one page
    rows += [(200 + i, f"Menu\nonly {i}", "c") for i in range(3)]             # too few pages
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = by_id(line_dedup.drop_site_lines(df, df["source"], dropped_col="n"))
    assert got[3]["text"] == "body 3" and got[3]["n"] == 2
    assert got[105]["text"] == "same page\nall of it"
    assert got[201]["text"] == "Menu\nonly 1"
    same = by_id(line_dedup.drop_site_lines(edges, edges["source"]))
    for i, t, *_ in edge_rows():
        assert same[i]["text"] == t and same[i]["__words"] == f"extra{i}"


# --------------------------------------------------------- substring dedup ----

def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for a in range(len(ws) - k + 1):
            w = tuple(ws[a:a + k])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = {a + j for a in range(len(ws) - k + 1) if first[tuple(ws[a:a + k])] < i for j in range(k)}
        out[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    return out


def test_substring_dedup_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(12)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(30)]
    rows = []
    for i in range(80):
        a, b = rng.choice(base).split(), rng.choice(base).split()
        cut = rng.randint(0, 30)
        rows.append((i, " ".join(a[:cut] + rng.choices(vocab, k=rng.randint(0, 4)) + b[cut // 2:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in (5, 13):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"]).decode())
               for r in debruijn.remove_repeats(df, k=k).collect()}
        assert got == brute_repeats(rows, k)


def test_substring_dedup_edges(spark, edges):
    got = by_id(debruijn.remove_repeats(edges))
    want = brute_repeats([(i, t) for i, t, *_ in edge_rows()], 13)
    for i, r in got.items():
        assert (r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) == want[i]
    assert got[9]["n_removed"] == 60 and got[5]["n_removed"] == got[5]["n_words"]


def test_substring_dedup_null_ids_and_repeated_ids(spark):
    """A row without an id loses nothing and is no source; rows that share an
    id are judged and are sources each with its own text."""
    long = [f"a{k}" for k in range(60)]
    other = [f"b{k}" for k in range(20)]
    fork = [f"c{k}" for k in range(8)]
    texts = [(None, " ".join(long)), (None, " ".join(long)), (None, "short"), (1, " ".join(other)),
             (1, " ".join(long[:30] + fork + long[30:])), (1, None), (2, " ".join(["x", *long[31:], "y"])),
             (2, " ".join([*other, "z"])), (3, " ".join(long + other)), (3, "few words"),
             (3, " ".join(long + other)), (4, " ".join(long[:30] + fork + other))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = Counter((r[0], r[1], r[2], bytes(r[3]).decode())
                  for r in debruijn.remove_repeats(df).collect())
    first = {}
    for i, t in texts:
        ws = (t or "").split()
        for a in range(len(ws) - 12):
            if i is not None:
                w = tuple(ws[a:a + 13])
                first[w] = min(first.get(w, i), i)
    want = Counter()
    for i, t in texts:
        ws = (t or "").split()
        gone = {a + j for a in range(len(ws) - 12) if i is not None and first[tuple(ws[a:a + 13])] < i
                for j in range(13)}
        want[i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)] += 1
    assert got == want


# ------------------------------------------------------------ Jaccard join ----

def brute_classes(rows, k, pct):
    sets = {}
    for i, t in rows:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
        sets[i] = ({tuple(ws[a:a + k]) for a in range(len(ws) - k + 1)} if len(ws) >= k
                   else {tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= pct * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,pct", [(3, 90), (5, 80)])
def test_jaccard_classes_brute_force(spark, k, pct):
    rng = random.Random(k)
    vocab = [f"t{n}" for n in range(400)]
    base = [rng.choices(vocab, k=rng.randint(1, 120)) for _ in range(8)]
    rows = []
    for i in range(150):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(vocab).upper()
        rows.append((i * 3, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_orders.link_classes(df, k=k, pct=pct).collect()}
    assert got == brute_classes(rows, k, pct)


def test_jaccard_edges(spark, edges):
    got = {r[0]: (r[1], r[2]) for r in jaccard_orders.link_classes(edges, k=3, pct=90).collect()}
    assert got == brute_classes([(i, t) for i, t, *_ in edge_rows()], 3, 90)


def test_parity_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    packed, sets = [], []
    for n in (1, 5, 400, 600, 1500, 3000):
        u = np.unique(rng.integers(0, 4000, n).astype(np.uint64))
        sets.append(set(u.tolist()))
        packed.append(jaccard_orders._parity(u))
    sk = jaccard_orders._Sketches(packed)
    for a in range(len(sets)):
        d = sk.apart(np.array(a), np.arange(len(sets)))
        for b in range(len(sets)):
            assert d[b] <= len(sets[a] ^ sets[b])
    assert (sk.apart(np.arange(len(sets)), np.arange(len(sets))) == 0).all()


# --------------------------------------------------------- decontamination ----

def brute_infix(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_infix_distance_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item = rng.integers(1, 4, rng.integers(1, 8)).astype(np.uint64)
        text = rng.integers(1, 4, rng.integers(0, 12)).astype(np.uint64)
        d, at, n = decontam.infix_distance(item, text)
        assert d == brute_infix(item.tolist(), text.tolist())
        # the run that is reported has that distance as a whole
        run = text[at:at + n].tolist()
        full = list(range(len(run) + 1))
        for k, w in enumerate(item.tolist()):
            new = [k + 1]
            for j, x in enumerate(run):
                new.append(min(full[j] + (x != w), full[j + 1] + 1, new[j] + 1))
            full = new
        assert full[-1] == d


def test_every_walk_finds_the_starts_that_serve_it():
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(3000)], k=rng.randint(15, 20))).encode())
             for i in range(40)]
    index = decontam.Index(items)
    for k, w in enumerate(index.words):
        want = {(o, k, o) for walk in index.ends for lv in walk for e in lv.values() for i, o in e if i == k}
        flat = np.concatenate([w, np.full(100, decontam._GAP, np.uint64)])
        assert want <= {tuple(x) for x in index.starts(flat).tolist()}


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(9)
    vocab = [f"word{k}" for k in range(3000)] + ["the", "of", "and", "to"] * 200
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(15, 60)))) for i in range(30)]
    rows, want = [], set()
    for i in range(400):
        ws = rng.choices(vocab, k=rng.randint(0, 200))
        if i % 2:
            k, text = rng.choice(items)
            x = text.split()
            for _ in range(int(len(x) * 0.01 * rng.randint(0, 18))):
                p, op = rng.randrange(len(x)), rng.randrange(3)
                x[p:p + 1] = [[rng.choice(vocab)], [x[p], rng.choice(vocab)], []][op]
            at = rng.randint(0, len(ws))
            ws[at:at] = x
        rows.append((i, " ".join(ws).title()))
    for i, t in rows:
        w = decontam.norm_words(t.encode())
        for k, text in items:
            item = decontam.norm_words(text.encode())
            if decontam.infix_distance(item, w)[0] <= len(item) // 5:
                want.add((i, k))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.benchmark_leaks(df, it).collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want) and len(want) >= 190


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 19, 20, 22, 25, 26, 40, 60])
def test_decontamination_recall_at_the_limit_of_every_length(n):
    """Random edits, as many as the limit allows."""
    rng = random.Random(n)
    vocab = [f"word{k}" for k in range(3000)] + ["the", "of", "and", "to"] * 200
    items, texts = [], []
    for i in range(100):
        x = rng.choices(vocab, k=n)
        items.append((i, " ".join(x).encode()))
        for _ in range(n // 5):
            p, op = rng.randrange(len(x)), rng.randrange(3)
            x[p:p + 1] = [[rng.choice(vocab)], [x[p], rng.choice(vocab)], []][op]
        texts.append(" ".join(rng.choices(vocab, k=30) + x + rng.choices(vocab, k=30)).encode())
    index = decontam.Index(items)
    words = [decontam.norm_words(t) for t in texts]
    got = {(t, k) for t, k, *_ in decontam.leaks_of(words, index)}
    due = {i for i, w in enumerate(words) if decontam.infix_distance(index.words[i], w)[0] <= n // 5}
    assert len(due) > 90 and len([i for i in due if (i, i) in got]) >= 0.93 * len(due)


def test_decontamination_in_blocks(spark, edges, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (4, ORDINARY), (5, ORDINARY), (None, ORDINARY)],
                                  "item_id bigint, text string")
    whole = sorted(map(tuple, decontam.benchmark_leaks(edges, items).collect()))
    for name, v in (("BLOCK_ITEMS", 1), ("BLOCK_BYTES", 100)):
        with monkeypatch.context() as m:
            m.setattr(decontam, name, v)
            assert sorted(map(tuple, decontam.benchmark_leaks(edges, items).collect())) == whole
    assert {r[1] for r in whole} == {1, 4, 5}


def test_decontamination_edges(spark, edges):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, ORDINARY), (5, ORDINARY)],
                                  "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.benchmark_leaks(edges, items).collect()}
    assert got == {(8, 1), (9, 1), *itertools.product((4, 5, 6, 11), (4, 5))}


# -------------------------------------------------------------------- BPE ----

def test_bpe_equals_tiktoken(spark, edges):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(bpe.vocabulary(path)))
    got = by_id(bpe.encode_decode(edges, path, public_tokenizers.PATTERN))
    for i, t, *_ in edge_rows():
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    c = bpe.codec(bpe.vocabulary(path), public_tokenizers.PATTERN)
    rng = random.Random(4)
    alpha = "abcdefghij  \n\t\x1c\x1f\x85\xa0 é漢😀0123'sSt.,!<-_"
    for _ in range(3000):
        x = "".join(rng.choices(alpha, k=rng.randint(0, 40)))
        assert np.frombuffer(c.encode(x), "<u4").tolist() == enc.encode_ordinary(x)
        assert c.decode(c.encode(x)) == x.encode()


def test_bpe_long_piece_is_linear():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    c = bpe.codec(bpe.vocabulary(path), public_tokenizers.PATTERN)
    x = "".join(random.Random(1).choices("abcdeeetao", k=200_000))
    assert c.decode(c.encode(x)) == x.encode()
    assert hashlib.sha256(c.encode(LONG)).hexdigest() == hashlib.sha256(c.encode(LONG)).hexdigest()


