"""Token counts by rank-synchronous array merging.

A text is cut at special strings and white space; equal chunks are counted
once per slice of texts.  The pre-tokens of all new chunks of a slice lie in
one ragged numpy array of byte symbols.  In every round each sequence's
adjacent pair of lowest rank is found for all sequences at once, all its
occurrences are merged together, and sequences without a mergeable pair leave
with the number of symbols they have left.

Merging all occurrences of a pair at once equals one merge after the other
because no merge that uses a merged symbol ranks below the merge that makes it;
this is checked when the vocabulary is read.

The vocabulary file is read on the driver (its path is a parameter, its size is
checked) and broadcast.  A worker holds one slice of texts (about
``SLICE_CHARS`` characters, or one longer text) and a bounded table of counts.

Defined results: a NULL or empty text has no bytes and no tokens; a text of
white space alone has no tokens; special strings inside a text are one token
each; equal rows have equal results; a very long text is counted whole; an empty
table gives an empty table; other columns are carried through (one named like
a result column is replaced).
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, vocabulary
from .common import table

# --- fixed values -----------------------------------------------------------
SLICE_CHARS = 1 << 20         # characters of texts counted together
CACHE_CHUNKS = 200_000        # counts a worker remembers; only speed depends on it
CACHE_CHARS = 48              # longest chunk that is remembered
NONE = np.int32(2**31 - 1)    # rank of a pair that no merge makes
NORMALIZERS = [{"type": "NFC"},
               {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
               {"type": "Lowercase"}]
NEWER_CASE = {0xA7CB: 0x0264, 0xA7DC: 0x019B}  # lower case that Python's tables lack
LETTER_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# ---------------------------------------------------------------------------

_SEPARATORS = re.compile("[\x1c-\x1f]")       # white space to str.split only
_GAPS = re.compile(f"[{SPACE}]+")


class PairTable:
    """Rank of a pair of symbols: a few tables of slots, each for the pairs
    that found their slot taken in the one before."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        odd = 0x9E3779B97F4A7C15
        while len(keys):
            if len(self.levels) == 64:
                raise ValueError("a pair occurs twice in the merges")
            at = self._slot(keys, np.uint64(odd))
            held = np.full(1 << self.bits, np.uint64(2**64 - 1))
            rank = np.full(1 << self.bits, NONE, np.int32)
            _, first = np.unique(at, return_index=True)
            held[at[first]], rank[at[first]] = keys[first], ranks[first]
            self.levels.append((np.uint64(odd), held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            odd = (odd * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def _slot(self, keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        mixed = keys ^ (keys >> np.uint64(29))
        return ((mixed * odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        for odd, held, rank in self.levels:
            at = self._slot(keys, odd)
            np.copyto(out, rank[at], where=held[at] == keys)
        return out


class Merger:
    """Token counter of one lower-casing byte BPE vocabulary with word ends."""

    def __init__(self, raw: bytes):
        import regex
        conf = json.loads(raw)
        model, pre = conf["model"], conf["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers") or [{}, {}]
        if ((conf["normalizer"] or {}).get("normalizers") != NORMALIZERS or model["type"] != "BPE"
                or steps[0].get("pattern", {}).get("Regex") != LETTER_SPLIT
                or steps[0].get("behavior") != "Removed" or not steps[0].get("invert")
                or steps[-1].get("type") != "ByteLevel" or steps[-1].get("use_regex")
                or steps[-1].get("add_prefix_space") or len(steps) != 2 or conf["post_processor"]
                or model.get("ignore_merges") or model.get("dropout")
                or model.get("continuing_subword_prefix") or any(
                    a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]
                    for a in conf["added_tokens"])):
            raise ValueError("a tokenizer of another kind")
        # chunks hold no white space, so \\s of the pattern's last class drops out
        self.find = regex.compile(LETTER_SPLIT.replace("[^\\s", "[^")).findall
        special = sorted((a["content"] for a in conf["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_letters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        made_at = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made_at, self.made, np.arange(len(pairs)))
        if (np.maximum(made_at[left], made_at[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.pairs = PairTable(left, right)
        self.known: dict[str, int] = {}

    def symbols_left(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols that survive in every sequence; all sizes are above 0."""
        out = np.zeros(len(sizes), np.int64)
        open_, size = np.arange(len(sizes)), sizes.astype(np.int64)
        while len(open_):
            start = np.cumsum(size) - size
            seq = np.repeat(np.arange(len(size)), size)
            rank = np.full(len(ids), NONE, np.int32)
            rank[:-1] = self.pairs.ranks(ids[:-1], ids[1:])
            rank[start + size - 1] = NONE
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            out[open_[done]] = size[done]
            hit = np.flatnonzero((rank == low[seq]) & (rank != NONE))
            # in a run of one symbol every other place merges, from the left
            run = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1))) if len(hit) else hit
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[within % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stay = ~done[seq]
            stay[hit + 1] = False
            size = size - np.bincount(seq[hit], minlength=len(size))
            ids, open_, size = ids[stay], open_[~done], size[~done]
        return out

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        """Tokens of every chunk of characters other than white space."""
        found = list(map(self.find, chunks))
        tokens = {t: k for k, t in enumerate(dict.fromkeys(t for ts in found for t in ts))}
        if not tokens:
            return [0] * len(chunks)
        packed = [t.encode("utf-8") for t in tokens]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        data = np.frombuffer(b"".join(packed), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[data[ends]]
        left = self.symbols_left(ids, sizes).tolist()
        return [sum(left[tokens[t]] for t in ts) for ts in found]

    def _cut(self, text: str) -> tuple[int, list[str]]:
        """Special strings of a text and its chunks."""
        if self.special is not None and self.special.search(text):
            n, parts = len(self.special.findall(text)), self.special.split(text)
        else:
            n, parts = 0, [text]
        out: list[str] = []
        for p in parts:
            if not p.isascii():
                # lower case letter by letter: no final sigma
                p = unicodedata.normalize("NFC", p).replace("Σ", "σ")
                for capital, small in NEWER_CASE.items():
                    p = p.replace(chr(capital), chr(small))
            p = p.lower()
            out += filter(None, _GAPS.split(p)) if _SEPARATORS.search(p) else p.split()
        return n, out

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Tokens of every text, in order."""
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for t in texts:
            held.append(self._cut(t) if t else (0, []))
            chars += len(t or "")
            if chars >= SLICE_CHARS:
                yield from self._solve(held)
                held, chars = [], 0
        yield from self._solve(held)

    def _solve(self, held: list[tuple[int, list[str]]]) -> list[int]:
        known = self.known
        new = list(set().union(*(chunks for _, chunks in held)).difference(known))
        known.update(zip(new, self.chunk_counts(new), strict=True))
        out = [n + sum(map(known.__getitem__, chunks)) for n, chunks in held]
        if len(known) > CACHE_CHUNKS:         # what the last slice used stays
            self.known = {c: known[c] for _, chunks in held for c in chunks}
            if len(self.known) > CACHE_CHUNKS:
                self.known = {}
        else:
            for c in new:
                if len(c) > CACHE_CHARS:
                    del known[c]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for every byte in byte-level vocabularies:
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden_ = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden_.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def merger(raw: bytes) -> Merger:
    """One counter per worker process and vocabulary."""
    return Merger(raw)


def token_counts(df: DataFrame, vocab_path: str, *, text_col: str = "text", limit: int = 2048,
                 bytes_col: str = "n_bytes", tokens_col: str = "n_tokens",
                 over_col: str = "over_limit") -> DataFrame:
    """``df`` with the UTF-8 bytes and tokens of ``text_col`` and whether the
    tokens exceed ``limit``."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = merger(vocab.value)
        for s in parts:
            yield pd.Series(list(m.counts(s)), dtype="int64")

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (bytes_col, tokens_col, over_col)]
    text = F.col(f"`{text_col}`").cast("string")
    counted = df.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias(bytes_col),
                        F.pandas_udf(run, "bigint")(text).alias(tokens_col))
    return counted.withColumn(over_col, F.col(f"`{tokens_col}`") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
