"""Token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import LONG, edge_rows
from tickerlens.llm import token_counts as T
from tickerlens.llm.bpe import vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ("abcABC  \n\t\x1c\x1f\x85\xa0 éÉ漢😀0123'sSt.,!<-_ΣσςİıſẞßÅÅé̀ﬁ①Ⅷ‍　 ½²'''ll'RE'd"
            "\x00\x01ꟋꟜ")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


def test_whole_table_equals_the_library(spark, library):
    from tickerlens.llm.common import table
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}
    got = T.op12_token_counts(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (
            len((texts[r["doc_id"]] or "").encode()), n, n > 2048)


def test_edges(spark, edges, empty, library):
    named = edges.withColumnsRenamed({"lang": "n_bytes", "__words": "__extra"})
    got = T.token_counts(named, PATH, limit=100).collect()
    text = {i: t for i, t, *_ in edge_rows()}
    assert len(got) == len(edge_rows())
    for r in got:
        assert r["n_tokens"] == library(text[r["doc_id"]]) and r["__extra"] == f"extra{r['doc_id']}"
        assert r["over_limit"] == (r["n_tokens"] > 100)
    assert {r["n_bytes"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert T.token_counts(empty, PATH).count() == 0


def test_random_texts_and_slices(monkeypatch, library):
    monkeypatch.setattr(T, "SLICE_CHARS", 200)
    monkeypatch.setattr(T, "CACHE_CHUNKS", 50)
    m, rng = T.Merger(vocabulary(PATH)), random.Random(6)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"{t}{s}{t}" for t, s in zip(texts, ["<|endoftext|>", "<|startoftext|>x", "<|endoftext"] * 99)]
    texts += [None, "", LONG, "aaaaaaaa" * 40, "<|endoftext|><|endoftext|>"]
    assert list(m.counts(texts)) == [library(t) for t in texts]


def test_one_long_word(library):
    x = "".join(random.Random(1).choices("abcdeeetao", k=60_000))
    assert list(T.merger(vocabulary(PATH)).counts([x])) == [library(x)]


def test_merging_equals_one_merge_after_the_other():
    """Few symbols and many ties: runs of one symbol merge from the left."""
    m = T.Merger.__new__(T.Merger)
    pairs = [(0, 0), (0, 1), (2, 2), (3, 0), (2, 0), (4, 4)]
    made = [2, 3, 4, 5, 6, 7]
    m.pairs = T.PairTable(*np.array(pairs, np.int32).T)
    m.made = np.array(made, np.int32)
    rng = random.Random(2)
    seqs = [rng.choices((0, 0, 0, 1), k=rng.randint(1, 12)) for _ in range(500)]

    def one_by_one(s):
        s = list(s)
        while True:
            at = [(pairs.index(p), k) for k, p in enumerate(zip(s, s[1:])) if p in pairs]
            if not at:
                return len(s)
            r, k = min(at)
            s[k:k + 2] = [made[r]]
    got = m.symbols_left(np.array(sum(seqs, []), np.int32), np.array(list(map(len, seqs))))
    assert got.tolist() == [one_by_one(s) for s in seqs]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        T.Merger(vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
