"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
the vocabulary finds, for every start of a piece, the longest token there.
The encoder takes longest tokens from the left; a token may follow its left
neighbour only if the pair would survive the merge order (a memoised test on
the tokens' own merge trees).  A token that may not follow is replaced by its
next shorter prefix, and when none is left the encoder steps back one token.
Every position is given up at most once, so the work is linear, and the one
sequence whose neighbours are all compatible is exactly the merge result.
Texts are taken in slices of about ``SLICE_CHARS`` characters (or one longer
text); equal pieces of a slice are encoded once, and a worker remembers a
bounded number of pieces, those met last.

Texts go through one Arrow UDF; only the text column leaves the JVM.  The
vocabulary file is read on the driver (its path is a parameter, its size is
checked) and broadcast.

Defined results: a NULL or empty text has no ids and decodes to empty bytes;
ids are packed as little-endian unsigned 32-bit integers; an empty table
gives an empty table; a very long text is encoded whole; other columns are
carried through.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_VOCAB_BYTES = 32 << 20    # bound of what is broadcast
SLICE_CHARS = 1 << 18         # characters of texts encoded together
CACHE_PIECES = 120_000        # two fillings stay in a worker; only speed depends on these
CACHE_PAIRS = 100_000
CACHE_KEY_CHARS = 64
# white space as the pattern's \s has it (Unicode White_Space)
SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
         "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# ---------------------------------------------------------------------------


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in
            (line.split() for line in raw.splitlines() if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex
        self.find = regex.compile(_own_space(pattern)).findall
        self.token = {r: t for t, r in ranks.items()}
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.auto = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.auto.add_word(t, r)
        self.auto.make_automaton()
        self.reach = max(self.size.values())
        self.shorter: dict[int, int] = {}
        for t, r in self.rank.items():
            k = len(t) - 1
            while k and t[:k] not in self.rank:
                k -= 1
            self.shorter[r] = self.rank[t[:k]] if k else -1
        self.parts: dict[int, tuple[int, int]] = {}     # token -> the two it merges
        self.merged: dict[tuple[int, int], int] = {}
        # the longest token that begins every prefix of a token
        self.longest: dict[str, int] = {"": -1}
        for t in self.rank:
            for k in range(1, len(t) + 1):
                if t[:k] not in self.longest:
                    self.longest[t[:k]] = self.rank.get(t[:k], self.longest[t[:k - 1]])
        self.fits: dict[int, bool] = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(t) > 1:
                self._learn(t, r)
        self.fits.clear()
        self.pack = {r: r.to_bytes(4, "little") for r in self.token}
        self.whole = {t: self.pack[r] for t, r in self.rank.items() if t.isascii()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, text: str, rank: int) -> None:
        """The last merge inside a token: the split into two lower tokens that
        may stand side by side under the merges known so far."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.rank.get(text[self.size[left]:])
            if right is not None and left < rank and right < rank and self._fit(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _fit(self, a: int, b: int) -> bool:
        """May ``a`` be followed by ``b``?  Undo the younger of the two tokens
        at the border again and again; no merge across the border may be older
        than the one undone last."""
        bound = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                return True
            # the younger merge is undone; at equal ranks the left one is older
            if pb is None or (pa is not None and a > b):
                if a >= bound:
                    return True
                bound, a = a, pa[1]
            else:
                if b + 1 > bound:
                    return True
                bound, b = b + 1, pb[0]

    def _remember(self, left: int, right: int) -> bool:
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        ok = self.fits[left << 32 | right] = self._fit(left, right)
        return ok

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece of the pattern."""
        s = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        size, shorter, fits = self.size, self.shorter, self.fits
        in_trie, longest, reach = self.auto.longest_prefix, self.longest, self.reach
        ids: list[int] = []
        given_up: set[int] = set()
        n, pos, last = len(s), 0, -1
        ahead = s[:reach]
        tok = longest[ahead[:in_trie(ahead)]]
        while True:
            while tok >= 0:
                at = pos + size[tok]
                if at not in given_up:
                    if last < 0:
                        break
                    ok = fits.get(last << 32 | tok)
                    if ok is None:
                        ok = self._remember(last, tok)
                    if ok:
                        break
                tok = shorter[tok]
            if tok >= 0:
                ids.append(tok)
                if at == n:
                    return ids
                pos, last = at, tok
                ahead = s[pos:pos + reach]
                tok = longest[ahead[:in_trie(ahead)]]
            elif ids:
                given_up.add(pos)
                tok = ids.pop()
                pos -= size[tok]
                last = ids[-1] if ids else -1
            else:
                raise ValueError("the vocabulary lacks a byte")

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of every text, in order; texts are taken in slices, and
        equal pieces of a slice are encoded once."""
        held: list[list[str]] = []
        chars = 0
        for t in texts:
            held.append(self.find(t) if t else [])
            chars += len(t or "")
            if chars >= SLICE_CHARS:
                yield from self._slice(held)
                held, chars = [], 0
        yield from self._slice(held)

    def _slice(self, held: list[list[str]]) -> list[bytes]:
        """Only pieces that are not remembered pass the loop; the rest of a slice
        is set and dictionary work as a whole."""
        known, older, pack = self.known, self.older, self.pack.__getitem__
        long: list[str] = []
        for p in set().union(*held).difference(known):
            got = older.get(p)
            if got is None:
                got = self.whole.get(p)
                if got is None:
                    got = b"".join(map(pack, self.piece_ids(p)))
            known[p] = got
            if len(p) > CACHE_KEY_CHARS:
                long.append(p)
        out = [b"".join(map(known.__getitem__, ps)) for ps in held]
        for p in long:
            del known[p]
        if len(known) > CACHE_PIECES:             # what was not met since the last time goes
            self.older, self.known = known, {}
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        return next(self.encode_all([text]))

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.token.__getitem__, _native(ids)))


def _own_space(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out, so that white space does not
    depend on the regular-expression library."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        two = pattern[k:k + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            k += 2
        elif two == r"\S" and not in_class:
            out.append(f"[^{SPACE}]")
            k += 2
        elif c == "\\":
            out.append(two)
            k += 2
        else:
            in_class = c == "[" or (in_class and c != "]")
            out.append(c)
            k += 1
    return "".join(out)


def _native(ids: array) -> array:
    import sys
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


@functools.lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(read_ranks(raw), pattern)


def vocabulary(path: str) -> bytes:
    """The vocabulary file, at most ``MAX_VOCAB_BYTES``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return raw


def encode_decode(df: DataFrame, vocab_path: str, pattern: str, *, text_col: str = "text",
                  ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``df`` with the packed ids of ``text_col`` and, unless
    ``decoded_col`` is None, the bytes that those ids decode to."""
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    back = decoded_col is not None

    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(vocab.value, pattern)
        for s in texts:
            ids = list(c.encode_all(s))
            yield pd.DataFrame({"ids": ids, "decoded": [c.decode(i) if back else None for i in ids]})

    run = F.pandas_udf(both, "struct<ids: binary, decoded: binary>")
    from .common import hidden
    tmp, = hidden(df, "codec")
    out = [F.col(f"`{c}`") for c in df.columns if c not in (ids_col, decoded_col)]
    res = df.withColumn(tmp, run(F.col(f"`{text_col}`").cast("string")))
    out.append(F.col(tmp)["ids"].alias(ids_col))
    if back:
        out.append(F.col(tmp)["decoded"].alias(decoded_col))
    return res.select(*out)


def n_ids(packed: Column | str) -> Column:
    packed = F.col(packed) if isinstance(packed, str) else packed
    return (F.octet_length(packed) / 4).cast("bigint")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    import public_tokenizers
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return coded.select("doc_id", n_ids("ids").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
