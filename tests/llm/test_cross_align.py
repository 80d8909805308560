"""Two tokenizers aligned: brute force over byte ranges, hash round trips."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import edge_rows
from tickerlens.llm import cross_align as C
from tickerlens.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: k for k, c in enumerate(byte_letters())}
    in_a = {i: bytes(byte[c] for c in t)
            for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}

    def in_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, in_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, in_b(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        same = all(b"".join(t for _, t in z) == want for z in (x, y))
        return (x, y) if same else ([], [])
    return tokens


def brute(rows, tokens):
    """Rows of the contract for (id, text), by plain byte ranges."""
    docs, counts = [], Counter()
    for i, t in rows:
        x, y = tokens(t)
        ranges = []
        for z in (x, y):
            at, out = 0, []
            for k, b in z:
                out.append((k, at, at + len(b)))
                at += len(b)
            ranges.append(out)
        links, j = [], 0
        for a, s, e in ranges[0]:
            while j and ranges[1][j - 1][2] > s:
                j -= 1
            while j < len(ranges[1]) and ranges[1][j][1] < e:
                if ranges[1][j][2] > s:
                    links.append((a, ranges[1][j][0]))
                j += 1
        ends = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups, s = [], 0
        ia = ib = 0
        for e in ends:
            ga = gb = 0
            while ia + ga < len(ranges[0]) and ranges[0][ia + ga][2] <= e:
                ga += 1
            while ib + gb < len(ranges[1]) and ranges[1][ib + gb][2] <= e:
                gb += 1
            groups.append(",".join(str(k) for k, *_ in ranges[0][ia:ia + ga]) + "|"
                          + ",".join(str(k) for k, *_ in ranges[1][ib:ib + gb]))
            ia, ib, s = ia + ga, ib + gb, e
        counts.update(set(links))
        docs.append((i, len(x), len(y), len(ends), links, ";".join(groups)))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return Counter((i, na, nb, ng, len(ls), sum(counts[x] == best[x[0]] for x in ls),
                    sum(counts[x] for x in ls), g) for i, na, nb, ng, ls, g in docs)


def got(df):
    return Counter((r["doc_id"], *(r[c] for c in C.OUT), r["groups"]) for r in df.collect())


def test_brute_force_in_many_blocks_shards_and_salts(spark, libraries, monkeypatch):
    for name, v in (("BLOCK_CHARS", 300), ("SHARD_KEYS", 100), ("SALT_BLOCKS", 2), ("SALT_FACTOR", 0),
                    ("FAN_IN", 2), ("MERGE_KEYS", 50)):
        monkeypatch.setattr(C, name, v)
    rng = random.Random(12)
    alpha = "abc ab  the\n\tÉé漢字😀0123'sSt.,!<|endoftext|><s>▁\x00\x1c"
    rows = [(k, "".join(rng.choices(alpha, k=rng.randint(0, 60)))) for k in range(120)]
    rows += [(200, "an ordinary line of words"), (200, "an ordinary line of words"), (None, "a line"),
             (201, None), (202, ""), (203, "<|endoftext|> </s> <0x41>"), (204, "under▁score"), (205, " x ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(C.align_tokenizers(df, A, B)) == brute(rows, libraries)


def test_edges(spark, edges, empty, libraries):
    named = edges.withColumnsRenamed({"lang": "block", "source": "groups", "__words": "n_a"})
    assert got(C.align_tokenizers(named, A, B)) == brute([(i, t) for i, t, *_ in edge_rows()], libraries)
    assert C.align_tokenizers(empty, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert got(C.align_tokenizers(blank, A, B)) == Counter({(i, 0, 0, 0, 0, 0, 0, ""): 1 for i in (1, 2)})


def test_query_equals_brute_force_on_the_whole_table(spark, libraries):
    from tickerlens.llm.common import table
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    want = Counter((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")
                   for x in brute(rows, libraries).elements())
    df = C.op11_cross_alignment(spark, SF_SMALL)
    assert df.columns == ["doc_id", *C.OUT, "groups_sha256"]
    assert Counter(tuple(r) for r in df.collect()) == want


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 64, 1000, 70_000):
        keys = np.unique(rng.integers(0, 2**40, 2 * n + 1))[:n]
        h = C.MinimalHash.unpack(C.MinimalHash.build(keys).pack())
        assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
        other = h.index(rng.integers(2**41, 2**42, 1000))
        assert ((other >= -1) & (other < max(len(keys), 1))).all()
    with pytest.raises(ValueError):
        C.MinimalHash.build(np.array([5, 5]))


def test_very_long_runs_of_white_space(libraries):
    from tickerlens.llm.bpe import vocabulary
    p = C.tokenizers(vocabulary(A), vocabulary(B))
    for gap in (" " * (C.LONG_GAP + 7), "\n" * (C.LONG_GAP + 7) + "x", " a" * C.LONG_GAP):
        a, b = next(p.encode([gap]))
        assert (a, b) == tuple([i for i, _ in x] for x in libraries(gap))
