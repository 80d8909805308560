"""Benchmark decontamination with CGK random-walk embedding and LSH.

A random walk reads a word sequence from some start: at every step it emits
the word under its pointer, and a random bit of (word, step) says whether the
pointer moves on.  Two sequences at small edit distance emit sequences at
small Hamming distance, because walks that got out of step by an edit meet
again.  Bit sampling keeps a few steps of the walk as a key; several walks and
every start inside an item give the repetitions that reach the recall target.

Walks run over all word positions of all texts (flat numpy arrays, several
texts at a time); a start is dropped as soon as its first sampled words match
no item, so almost all of them end after a few steps.  Starts that keep the
whole key name an item and a shift; the item-sized window around them is then
compared exactly: the smallest word edit distance of the item to any run of
words in it.  Nothing is shuffled.  Items are a stated query set: they are
indexed in blocks of bounded rows and bytes, each broadcast and run against all
texts; with more than one block the results of each are written before the next.

Short items leave few words between their edits, so they have more walks, and
their keys end as soon as they tell a few words.

A text holds an item if some run of its words has an edit distance of at most
20 % of the item's words.  Words are compared in lower case, without
ASCII punctuation at their ends.

Defined results: NULL or empty texts and items match nothing; an item without an
id is left out, a text without one is reported under NULL; repeated items are
reported each under its id, repeated texts each under theirs; of equally near
runs of a text the first counts; a very long text is searched whole; empty
tables give an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import stored

# --- fixed values -----------------------------------------------------------
WALKS = 4                     # repetitions, each with its own random bits
STEPS = (0, 3, 6, 10, 14, 18) # sampled steps of a walk
MIN_TOLD = 5                  # different words that a key tells
SHORT = 26                    # items of fewer words have more walks and shorter keys
SHORT_WALKS = 8
SHORT_TOLD = ((20, 5), (14, 4), (6, 3), (0, 2))   # least words of the item, words its keys tell
MAX_ERROR_PCT = 20            # edits per 100 words of the item
BLOCK_ITEMS = 20_000          # items indexed and broadcast together, and their bytes
BLOCK_BYTES = 8 << 20
CHUNK_WORDS = 150_000         # words walked over together in a task
BITS = 1 << 18                # size of the pre-filters
CACHE_WORDS = 150_000
# ---------------------------------------------------------------------------

_MARKS = string.punctuation.encode()
_GAP = np.uint64(0)           # stands between texts; equals no word
_SCHEMA = "id bigint, item_id bigint, at int, n_words int, distance int"


class _Words(dict):
    """Hash of a word in lower case without punctuation at its ends."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = w.strip(_MARKS)
        core = core.lower() if core.isascii() else core.decode("utf-8", "replace").lower().encode()
        h = self[w] = xxhash.xxh3_64_intdigest(core) | 1
        return h


_WORDS = _Words()


def norm_words(text: bytes | None) -> np.ndarray:
    ws = S.split_words(text)
    return np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))


def _bits(words: np.ndarray, walk: int) -> np.ndarray:
    return S.mix(words, walk + 11)


def _grow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return S.mix(key * S.STEP + word, 2)


class Index:
    """Keys of all starts inside the items of one block."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.words = [], []
        for i, text in sorted(items):
            w = norm_words(text)
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        # per walk and level: keys that go on, and keys that end there
        walks = SHORT_WALKS if any(len(w) < SHORT for w in self.words) else WALKS
        self.open = [[np.empty(0, np.uint64)] * len(STEPS) for _ in range(walks)]
        self.ends: list[list[dict[int, list[tuple[int, int]]]]] = [
            [{} for _ in STEPS] for _ in range(walks)]
        for r in range(walks):
            seen: list[set[int]] = [set() for _ in STEPS]
            for k, w in enumerate(self.words):
                if r < WALKS or len(w) < SHORT:
                    self._add(r, k, w, seen)
            self.open[r] = [np.sort(np.fromiter(s, np.uint64, len(s))) for s in seen]
        self.filters = [[self._filter(o) for o in lv] for lv in self.open]

    def _add(self, r: int, k: int, w: np.ndarray, seen: list[set[int]]) -> None:
        n = len(w)
        bits = _bits(w, r)
        key = np.zeros(n, np.uint64)
        ptr = np.arange(n)
        level = np.full(n, -1)
        step = 0
        keys = np.zeros((len(STEPS), n), np.uint64)
        told = np.zeros((len(STEPS), n), np.int64)   # different words of the item in the key
        before = np.full(n, -1)
        for lv, at in enumerate(STEPS):
            while step < at:
                inside = ptr < n
                ptr[inside] += (bits[ptr[inside]] >> np.uint64(step)).astype(np.int64) & 1
                step += 1
            inside = (ptr < n) & (level == lv - 1)
            key[inside] = _grow(key[inside], w[ptr[inside]])
            level[inside] = lv
            told[lv] = (told[lv - 1] if lv else 0) + (inside & (ptr != before))
            before = ptr.copy()
            keys[lv] = key
        if n < SHORT:
            # a key ends where it tells enough: short keys survive edits
            need = min(next(t for least, t in SHORT_TOLD if n >= least), told[-1].max())
            end = (told < need).sum(axis=0)
            serve = np.flatnonzero(told[-1] >= need)
        else:
            # a walk that stood still tells few words; it serves if there is no better
            last = level.max()
            end = np.full(n, last)
            reached = np.where(level < last, 0, told[-1])
            serve = np.flatnonzero((level == last) & (reached >= min(MIN_TOLD, reached.max())))
        for o in serve:
            last = int(end[o])
            for lv in range(last + 1):
                seen[lv].add(int(keys[lv, o]))
            self.ends[r][last].setdefault(int(keys[last, o]), []).append((k, int(o)))

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        f = np.zeros(BITS, bool)
        f[(keys & np.uint64(BITS - 1)).astype(np.int64)] = True
        return f

    @staticmethod
    def _walk(flat: np.ndarray, ptr: np.ndarray, r: int, step: int, at: int) -> np.ndarray:
        """Pointers after the steps from ``step`` to ``at``; a step draws the
        bits of the words it stands on, few by then."""
        while step < at:
            ptr = ptr + ((_bits(flat[ptr], r) >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
            step += 1
        return ptr

    def starts(self, flat: np.ndarray) -> np.ndarray:
        """(position, item, shift) of every start in ``flat`` that shares a
        whole key with an item, without repetitions."""
        found: list[np.ndarray] = []
        # the first sampled word is the start itself, but which starts serve
        # depends on the walk
        first = _grow(np.zeros(len(flat), np.uint64), flat)
        low = (first & np.uint64(BITS - 1)).astype(np.int64)
        for r in range(len(self.open)):
            sure = np.flatnonzero(self.filters[r][0][low] & (flat != _GAP))
            pos, ptr, key, step = sure, sure.copy(), first[sure], 0
            for lv, at in enumerate(STEPS):
                if step < at and len(ptr):
                    ptr = self._walk(flat, ptr, r, step, at)
                step = at
                if lv:
                    key = _grow(key, flat[ptr])
                    ok = self.filters[r][lv][(key & np.uint64(BITS - 1)).astype(np.int64)]
                    ok &= flat[ptr] != _GAP
                    pos, ptr, key = pos[ok], ptr[ok], key[ok]
                ends = self.ends[r][lv]
                if ends and len(key):
                    hit = np.flatnonzero(np.isin(key, np.fromiter(ends, np.uint64, len(ends))))
                    for h in hit:
                        p = int(pos[h])
                        found.extend((p, k, o) for k, o in ends[int(key[h])])
        return np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to a run of ``text`` and that run
    (first word, number of words); the earliest end, then the longest run."""
    n = len(text)
    idx = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for k, w in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = k + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != w), out=new[1:])
        row = np.minimum.accumulate(new - idx) + idx
    end = int(row.argmin())
    best = int(row[end])
    # the run that ends there: the same table backwards, with a fixed end
    back = text[:end][::-1]
    m = len(back)
    idx = np.arange(m + 1)
    row = idx.copy()
    for k, w in enumerate(item[::-1]):
        new = np.empty(m + 1, np.int64)
        new[0] = k + 1
        np.minimum(row[1:] + 1, row[:-1] + (back != w), out=new[1:])
        row = np.minimum.accumulate(new - idx) + idx
    length = int(np.flatnonzero(row == best).max())
    return best, end - length, length


def _allowed(n: int) -> int:
    return n * MAX_ERROR_PCT // 100


def leaks_of(words: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, at, n_words, distance) over several texts."""
    pad = np.full(max(STEPS) + 1, _GAP)
    parts: list[np.ndarray] = []
    base, at = [], 0
    for w in words:
        base.append(at)
        parts += [w, pad]
        at += len(w) + len(pad)
    if not parts:
        return []
    flat, base = np.concatenate(parts), np.array(base)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: set[tuple[int, int, int]] = set()
    for p, k, o in index.starts(flat):
        t = int(np.searchsorted(base, p, "right")) - 1
        item, text = index.words[k], words[t]
        slack = _allowed(len(item))
        begin = int(p - base[t] - o)
        cell = (t, int(k), begin // (slack + 1))
        if cell in done:
            continue
        done.add(cell)
        lo = max(0, begin - 2 * slack - 1)
        window = text[lo:max(0, begin + len(item) + 2 * slack + 1)]
        # at least so many words of the item must stand in the window
        if np.isin(item, window).sum() < len(item) - slack:
            continue
        d, a, n = infix_distance(item, window)
        if d <= slack and n:
            old = best.get((t, int(k)))
            if old is None or (d, lo + a) < old[:2]:
                best[t, int(k)] = (d, lo + a, n)
    return [(t, index.ids[k], a, n, d) for (t, k), (d, a, n) in sorted(best.items())]


def benchmark_leaks(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                    text_col: str = "text", item_id: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """id, item_id, at, n_words, distance: the best run (smallest distance,
    then first word) of every (text, item) that match."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("bigint").alias("id"),
                      F.col(text_col).cast("string").cast("binary").alias("text"))
    items = items.select(F.col(item_id).cast("bigint").alias("i"),
                         F.col(item_text).cast("string").cast("binary").alias("t"))
    items = items.filter(F.col("t").isNotNull() & F.col("i").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil((size["b"] or 0) / BLOCK_BYTES))
    out = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = [(r["i"], bytes(r["t"])) for r in block.collect()]
        index = spark.sparkContext.broadcast(Index(rows))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value

            def flush(ids, words):
                got = leaks_of(words, ix)
                cols = [[ids[g[0]] for g in got], *[[g[c] for g in got] for c in range(1, 5)]]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=["id", "item_id", "at", "n_words", "distance"])
            ids, words, size = [], [], 0
            for batch in batches:
                for i, t in zip(batch.column(0), batch.column(1), strict=True):
                    w = norm_words(t.as_py())
                    if len(w):
                        ids.append(i.as_py())
                        words.append(w)
                        size += len(w)
                    if size >= CHUNK_WORDS:
                        yield flush(ids, words)
                        ids, words, size = [], [], 0
            if words:
                yield flush(ids, words)

        part = texts.mapInArrow(run, _SCHEMA)
        if blocks > 1:                # one block's index is held at a time
            part = stored(part, "leaks")
            index.destroy()
        out = part if out is None else out.union(part)
    return out.select(F.col("id").alias(id_col), "item_id", "at", "n_words", "distance")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that match, over whole tables."""
    from .common import table
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
