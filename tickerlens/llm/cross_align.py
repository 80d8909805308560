"""Alignment of two tokenizers by byte ranges, with corpus-wide pair counts.

Every text is cut by both tokenizers into tokens that cover the same bytes.  A
token of A and a token of B whose ranges overlap are linked; bytes where tokens
of both end cut the text into groups.  How many documents hold a pair linked is
counted over the whole corpus:

1. texts are encoded once, in blocks of about ``BLOCK_CHARS`` characters; a
   block keeps its token ids, its distinct pairs and how many of its documents
   hold each;
2. the distinct pairs of all blocks are dealt by hash into shards of about
   ``SHARD_KEYS`` pairs; every shard gets a minimal perfect hash (levels of bit
   arrays, each for the keys that shared a place in the one before) and its
   keys in hash order;
3. blocks add their counts into dense vectors indexed by the hash, one per
   shard and salt; vectors are summed in rounds of bounded fan-in;
4. blocks look their pairs up again, each key verified, and the documents are
   aligned a second time from the stored ids.

Work is dealt by (shard, salt), a salt holding so many blocks that the repeated
hash tables stay small beside them, and by block.  Pairs are combined per block
before any shuffle, so a pair that every document holds is one row per block.
Only the best count of every A id is collected (rows bounded by A's
vocabulary).

Defined results: a NULL or empty text, and one whose tokens do not spell
space + text in either tokenizer, has no tokens (zeros, groups ''); every row is
a document, so repeated rows count one by one; a NULL id is kept; a very long
text is one block of its own; an empty table gives an empty table; the result
holds the id and the result columns only, so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import stored, table
from .token_counts import byte_letters

# --- fixed values -----------------------------------------------------------
BLOCK_CHARS = 2 << 20         # characters of the texts of one block, about
SHARD_KEYS = 1 << 16          # distinct pairs of one shard, about
SALT_BLOCKS = 64              # blocks of one salt, at least
SALT_FACTOR = 8               # blocks of one salt, times the shards
FAN_IN = 16                   # vectors summed in one task step
MERGE_KEYS = 1 << 21          # pairs a task holds before it passes them on
SPACE_MARK = "▁"
LONG_GAP = 50_000             # runs of white space that tiktoken's pattern cannot take
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---------------------------------------------------------------------------

_LONG_GAP = re.compile(r"\s{%d}" % LONG_GAP)
BLOCK_SCHEMA = "ids array<bigint>, na binary, nb binary, a binary, b binary, pairs binary, holders binary"
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# ------------------------------------------------------------- tokenizers ----

class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        import sentencepiece
        import tiktoken
        conf = json.loads(raw_a)
        vocab, pre = conf["model"]["vocab"], conf["pre_tokenizer"] or {}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in conf["model"]["merges"])
        made = [vocab[x + y] for x, y in pairs]
        if (conf["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
                or pre.get("add_prefix_space") or conf["model"].get("end_of_word_suffix")
                or any(x >= y for x, y in zip(made, made[1:]))):
            raise ValueError("a tokenizer of another kind")
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        # ids are in the order of the merges, so they serve as ranks; no special
        # tokens are known here, so their strings are plain text
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        self.raw_a, self.plain = raw_a, None
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i)
                        else p.replace(SPACE_MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)

    def ids_a(self, text: str) -> list[int]:
        if len(text) < LONG_GAP or not _LONG_GAP.search(text):
            return self.a.encode_ordinary(text)
        if self.plain is None:
            from tokenizers import Tokenizer
            self.plain = Tokenizer.from_buffer(self.raw_a)
            self.plain.encode_special_tokens = True
        return self.plain.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of every text in both tokenizers; none unless both spell it."""
        for t, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            a, want = self.ids_a(f" {t}"), f" {t}".encode()
            same = t and (b"".join(map(self.bytes_a.__getitem__, a)) == want
                          and b"".join(map(self.bytes_b.__getitem__, b)) == want)
            yield (a, b) if same else ([], [])


@functools.lru_cache(maxsize=2)
def tokenizers(raw_a: bytes, raw_b: bytes) -> Pair:
    """Both tokenizers, once per worker process."""
    return Pair(raw_a, raw_b)


# -------------------------------------------------------------- alignment ----

class Aligned:
    """Links and groups of the documents of a block, laid end to end."""

    def __init__(self, a, b, na, nb, size_a, size_b):
        self.a, self.b, self.na, self.nb = a, b, na, nb
        last_a, last_b = np.cumsum(size_a[a]) - 1, np.cumsum(size_b[b]) - 1
        total = int(last_a[-1]) + 1 if len(a) else 0
        end_a, end_b = np.zeros(total, bool), np.zeros(total, bool)
        end_a[last_a] = True
        end_b[last_b] = True
        # every link is the stretch of bytes that ends where either token ends
        at = np.flatnonzero(end_a | end_b)
        self.link_a = (np.cumsum(end_a) - end_a)[at]
        self.link_b = (np.cumsum(end_b) - end_b)[at]
        both = end_a & end_b
        group = np.cumsum(both) - both
        self.group_a, self.group_b = group[last_a], group[last_b]
        # documents end where both end: links and groups up to every end
        ends = np.concatenate(([0], np.cumsum(size_a[a])))[np.cumsum(na)]
        self.links_to = np.concatenate(([0], np.cumsum(end_a | end_b)))[ends]
        self.groups_to = np.concatenate(([0], np.cumsum(both)))[ends]

    def keys(self, width: int) -> np.ndarray:
        return self.a[self.link_a] * width + self.b[self.link_b]

    def per_doc(self, ups: np.ndarray) -> np.ndarray:
        return np.diff(ups, prepend=0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of the links over every document."""
        return self.per_doc(np.concatenate(([0], np.cumsum(values)))[self.links_to])

    def texts(self, names: list[str], span: int) -> list[str]:
        """Groups of every document: a1,a2|b1;a3|b2,b3."""
        groups = int(self.groups_to[-1]) if len(self.groups_to) else 0
        in_a = np.cumsum(np.bincount(self.group_a, minlength=groups))
        in_b = np.cumsum(np.bincount(self.group_b, minlength=groups))
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        closes = np.append(self.group_a[1:] != self.group_a[:-1], True)[:len(self.a)]
        before = np.concatenate(([0], in_b))[self.group_a]
        out[np.arange(len(self.a)) + before] = self.a + np.where(closes, span, 0)
        closes = np.append(self.group_b[1:] != self.group_b[:-1], True)[:len(self.b)]
        before = in_a[self.group_b] if len(self.b) else self.group_b
        out[np.arange(len(self.b)) + before] = self.b + np.where(closes, 2 * span, 0)
        parts, ends = list(map(names.__getitem__, out.tolist())), np.cumsum(self.na + self.nb).tolist()
        return ["".join(parts[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def _block(p: Pair, ids: list, texts: list[str]) -> tuple:
    """Packed ids of a block, its distinct pairs and their documents."""
    got = list(p.encode(texts))
    na, nb = (np.array([len(x[k]) for x in got], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in got for i in x[k]), np.int64, n.sum()) for k, n in ((0, na), (1, nb)))
    al = Aligned(a, b, na, nb, p.size_a, p.size_b)
    kinds = len(p.bytes_a) * len(p.bytes_b)
    doc = np.repeat(np.arange(len(ids)), al.per_doc(al.links_to))
    held = np.unique(doc * kinds + al.keys(len(p.bytes_b))) % kinds
    pairs, holders = np.unique(held, return_counts=True)
    small = "<u2" if max(len(p.bytes_a), len(p.bytes_b)) <= 1 << 16 else "<u4"
    return (ids, na.astype("<u4").tobytes(), nb.astype("<u4").tobytes(), pressed(a.astype(small)),
            pressed(b.astype(small)), pressed(pairs.astype("<u8")), pressed(holders.astype("<u4")))


def pressed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: ids and pairs are what is written and
    shuffled, and they press to about half."""
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def opened(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _ids(raw: bytes, n: int) -> np.ndarray:
    """Pressed token ids; their width follows from their number."""
    x = opened(raw, "u1")
    return x.view(f"<u{len(x) // n}").astype(np.int64) if n else x.astype(np.int64)


def encoded_blocks(df: DataFrame, vocab_a, vocab_b) -> DataFrame:
    """Blocks of the rows of ``df(id, text)``."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = tokenizers(vocab_a.value, vocab_b.value)
        ids: list = []
        texts: list[str] = []
        chars = 0

        def out():
            row = _block(p, ids, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[1:])],
                names=names)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                if ids and chars + len(t) > BLOCK_CHARS:
                    yield out()
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(t)
                chars += len(t)
        if ids:
            yield out()
    return df.mapInArrow(run, BLOCK_SCHEMA)


# --------------------------------------------------- minimal perfect hash ----

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of integer keys (multiply and shift, twice)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Numbers 0 .. n-1 for n distinct keys, about four bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                              # packed bits
        self.before, n = [], 0                            # ones before every word
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mixed(keys, level) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        levels = []
        while len(keys):
            if len(levels) == 200:
                raise ValueError("a key occurs twice")
            words = len(keys) // 32 + 1
            at = cls._place(keys, len(levels), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; any number or -1 for keys not hashed."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, words in enumerate(self.levels):
            at = self._place(keys[rest], level, len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = self.before[level][at[hit] >> 6] + np.bitwise_count(below)
            rest = rest[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return b"".join(x.tobytes() for x in (head, *self.levels))

    @classmethod
    def unpack(cls, raw: bytes) -> MinimalHash:
        x = np.frombuffer(raw, "<u8")
        n = int(x[0])
        cuts = 1 + n + np.concatenate(([0], np.cumsum(x[1:1 + n].astype(np.int64))))
        return cls([x[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)])


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs, 1 << 20) % np.uint64(shards)).astype(np.int64)


def _distinct(blocks: DataFrame) -> DataFrame:
    """Distinct pairs; a task combines its blocks' before it passes them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, "<u8")
        for b in batches:
            for x in b.column(0):
                held = np.union1d(held, opened(x.as_py(), "<u8"))
                if len(held) > MERGE_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64))], names=["pair"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64))], names=["pair"])
    return blocks.select("pairs").mapInArrow(run, "pair bigint").distinct()


def hashed_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, its minimal perfect hash and its keys in hash order."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(x, shards)), b.column(0)],
                                             names=["shard", "pair"])

    def build(t: pa.Table) -> pa.Table:
        keys = t.column("pair").to_numpy()
        h = MinimalHash.build(keys)
        order = np.empty(len(keys), "<u8")
        order[h.index(keys)] = keys
        return pa.table({"shard": t.column("shard")[:1], "hash": pa.array([h.pack()], pa.binary()),
                         "keys": pa.array([order.tobytes()], pa.binary())})
    return pairs.mapInArrow(dealt, "shard bigint, pair bigint").groupBy("shard").applyInArrow(
        build, "shard bigint, hash binary, keys binary")


# ----------------------------------------------------------------- counts ----

def _slices(blocks: DataFrame, shards: int) -> DataFrame:
    """The pairs of every block by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, x, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                pairs, holders = opened(x.as_py(), "<u8"), opened(h.as_py(), "<u4")
                shard = _shard(pairs, shards)
                order = np.argsort(shard, kind="stable")
                ids, first = np.unique(shard[order], return_index=True)
                cuts = np.append(first, len(order))
                rows = [order[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([block] * len(ids), pa.int64()),
                     pa.array([pressed(pairs[r]) for r in rows], pa.binary()),
                     pa.array([pressed(holders[r]) for r in rows], pa.binary())],
                    names=["shard", "block", "pairs", "holders"])
    return blocks.select("block", "pairs", "holders").mapInArrow(
        run, "shard bigint, block bigint, pairs binary, holders binary")


def _vector(slices: pa.Table, hashes: pa.Table) -> pa.Table:
    """Counts of the blocks of one salt in one dense vector of a shard."""
    h, n = MinimalHash.unpack(hashes.column("hash")[0].as_py()), hashes.column("n")[0].as_py()
    total = np.zeros(n, np.int64)
    for x, c in zip(slices.column("pairs"), slices.column("holders"), strict=True):
        np.add.at(total, h.index(opened(x.as_py(), "<u8")), opened(c.as_py(), "<u4"))
    return pa.table({"shard": hashes.column("shard")[:1], "salt": hashes.column("salt")[:1],
                     "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _summed(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in t.column("counts"))
    return pa.table({"shard": t.column("shard")[:1], "salt": t.column("salt")[:1],
                     "counts": pa.array([total.tobytes()], pa.binary())})


def _looked_up(slices: pa.Table, counted: pa.Table) -> pa.Table:
    """Counts of the pairs of every block of one salt in one shard."""
    h = MinimalHash.unpack(counted.column("hash")[0].as_py())
    keys = np.frombuffer(counted.column("keys")[0].as_py(), "<u8")
    counts = np.frombuffer(counted.column("counts")[0].as_py(), "<i8")
    out = []
    for x in slices.column("pairs"):
        pairs = opened(x.as_py(), "<u8")
        at = h.index(pairs)
        if (keys[at] != pairs).any():
            raise ValueError("a pair is not at its place")
        out.append(pressed(counts[at]))
    return pa.table({"block": slices.column("block"), "pairs": slices.column("pairs"),
                     "counts": pa.array(out, pa.binary())})


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, hash, keys, counts) of all pairs, and for every block its pairs
    with their counts."""
    pairs = stored(_distinct(blocks), "pairs")
    shards = max(1, -(-pairs.count() // SHARD_KEYS))
    salts = max(1, -(-blocks.count() // max(SALT_BLOCKS, SALT_FACTOR * shards)))
    hashes = stored(hashed_shards(pairs, shards), "hashes")
    slices = _slices(blocks, shards).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    each_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt")
    sizes = hashes.select("shard", "hash", (F.octet_length("keys") / 8).cast("bigint").alias("n"), each_salt)
    level = stored(slices.groupBy("shard", "salt").cogroup(sizes.groupBy("shard", "salt")).applyInArrow(
        _vector_or_none, "shard bigint, salt bigint, counts binary"), "vectors")
    while salts_left(level) > 1:
        level = level.withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        level = stored(level.groupBy("shard", "salt").applyInArrow(
            _summed, "shard bigint, salt bigint, counts binary"), "vectors")
    counted = stored(hashes.join(level.select("shard", "counts"), "shard"), "counts")
    looked = slices.groupBy("shard", "salt").cogroup(
        counted.select("*", each_salt).groupBy("shard", "salt")).applyInArrow(
        _looked_up_or_none, "block bigint, pairs binary, counts binary")
    return counted, looked


def salts_left(level: DataFrame) -> int:
    return (level.agg(F.max("salt").alias("s")).first()["s"] or 0) + 1


def _vector_or_none(slices: pa.Table, hashes: pa.Table) -> pa.Table:
    if not slices.num_rows:
        return pa.table({"shard": pa.array([], pa.int64()), "salt": pa.array([], pa.int64()),
                         "counts": pa.array([], pa.binary())})
    return _vector(slices, hashes)


def _looked_up_or_none(slices: pa.Table, counted: pa.Table) -> pa.Table:
    if not slices.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "pairs": pa.array([], pa.binary()),
                         "counts": pa.array([], pa.binary())})
    return _looked_up(slices, counted)


def best_counts(counted: DataFrame, width: int, size: int) -> np.ndarray:
    """The highest count of every A id; at most ``size`` rows are collected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0), b.column(1), strict=True):
                a = np.frombuffer(k.as_py(), "<u8").astype(np.int64) // width
                best = np.zeros(size, np.int64)
                np.maximum.at(best, a, np.frombuffer(c.as_py(), "<i8"))
                held = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(best[held])], names=["a", "best"])
    out = np.zeros(size, np.int64)
    rows = counted.select("keys", "counts").mapInArrow(run, "a bigint, best bigint")
    for r in rows.groupBy("a").agg(F.max("best").alias("best")).collect():
        out[r["a"]] = r["best"]
    return out


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups`` (ids
    of A and B by group, as a1,a2|b1;a3|b2,b3) of every row of ``df``."""
    raw_a, raw_b = vocabulary(path_a), vocabulary(path_b)
    sc = df.sparkSession.sparkContext
    vocab_a, vocab_b = sc.broadcast(raw_a), sc.broadcast(raw_b)
    p = tokenizers(raw_a, raw_b)
    width, span = len(p.bytes_b), max(len(p.bytes_a), len(p.bytes_b))
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = encoded_blocks(docs, vocab_a, vocab_b)
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    counted, looked = pair_counts(blocks)
    rest = sc.broadcast((p.size_a, p.size_b, best_counts(counted, width, len(p.bytes_a))))

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        size_a, size_b, best = rest.value
        cell = {c: block.column(c)[0].as_py() for c in ("ids", "na", "nb", "a", "b")}
        na, nb = (np.frombuffer(cell[c], "<u4").astype(np.int64) for c in ("na", "nb"))
        al = Aligned(_ids(cell["a"], int(na.sum())), _ids(cell["b"], int(nb.sum())), na, nb, size_a, size_b)
        keys, counts = (np.concatenate([np.zeros(0, kind), *(opened(x.as_py(), kind) for x in found.column(c))])
                        for c, kind in (("pairs", "<u8"), ("counts", "<i8")))
        order = np.argsort(keys)
        link = al.keys(width)
        count = counts[order][np.searchsorted(keys[order].astype(np.int64), link)] if len(link) else link
        cols = (na, nb, al.per_doc(al.groups_to), al.per_doc(al.links_to),
                al.sums(count == best[al.a[al.link_a]]), al.sums(count))
        return pa.table({"id": pa.array(cell["ids"], pa.int64()),
                         **{n: pa.array(c, pa.int64()) for n, c in zip(OUT, cols, strict=True)},
                         "groups": pa.array(al.texts(_names(span), span), pa.string())})

    out = blocks.select("block", "ids", "na", "nb", "a", "b").groupBy("block").cogroup(
        looked.groupBy("block")).applyInArrow(
        finish, "id bigint, " + ", ".join(f"{c} bigint" for c in OUT) + ", groups string")
    return out.withColumnRenamed("id", id_col)


@functools.lru_cache(maxsize=1)
def _names(span: int) -> list[str]:
    """Decimal ids with what may follow them."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(span)]


def op11_cross_alignment(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    import public_tokenizers
    out = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", *OUT, digest.alias("groups_sha256"))
