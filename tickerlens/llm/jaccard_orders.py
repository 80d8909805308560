"""Set-similarity join on word shingles by multiple-global-order filtering.

Two shingle sets of Jaccard similarity >= t must share a token among their
first ``n - ceil(t n) + 1`` tokens under *every* global order of all tokens.
Several orders are used together: plain hash orders with different seeds, under
which similar sets mostly begin with the same token, and rare-first orders
(frequency class, then hash), under which unlike sets seldom share a prefix:

1. Equal sets collapse to one representative (pre-aggregated), so a group of
   exact copies costs one row from there on.
2. Representatives whose first token agrees under a hash order meet in a
   bucket.
   It is cut into blocks of bounded size, and inside a block a pair is
   looked at only if its sizes and their parity sketches allow the
   similarity (toggled bits are a lower bound of the symmetric difference, so
   nothing is lost) and its sets are not connected already.  Only spanning
   links leave a task, never all pairs of a bucket.
3. Pairs that met under none of those orders are found by the prefix filter
   itself: tokens shared by two prefixes of a rare-first order, minus pairs
   that met or are connected, intersected with the prefixes of two more
   rare-first orders before the sets are compared.  This step makes the join exact.

Links are connected by large-star/small-star steps (``components``).

Defined results: a NULL text or a text without words has an empty set and is
linked with nothing; repeated rows with one id are one document (of rows that
share an id but not the text, one text counts for all of them; which one is not
defined); a row without an id has an empty set; equal sets belong to one class,
ties have no order; a very long text is one set, whole; an empty table gives an
empty table; the result has the id and the result columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import stored
from .components import components

# --- fixed values -----------------------------------------------------------
ORDERS = 4                    # global orders under which sets meet
PARITY_BITS = 512             # least size of a parity sketch (a power of two)
BLOCK = 512                   # sets of a bucket compared in one task step
GROUP_ROWS = 1500             # rows that share one task step, about
HEAVY_MAX = 100_000           # bound of the broadcast table of frequent tokens
HEAVY_BATCH = 8000            # documents counted together before pre-selection
HEAVY_LEAST = 4               # sets of a batch that make a token a proposal
# ---------------------------------------------------------------------------

FEATS = ("id bigint, n int, s1 bigint, s2 bigint, "
         + ", ".join(f"k{r} bigint" for r in range(ORDERS)) + ", parity binary, prefix array<bigint>")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.col(text_col).cast("string").cast("binary").alias("text"))


def heavy_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """The most frequent tokens (at most ``HEAVY_MAX``, sorted) and their
    frequency classes, as two rows.

    Every batch of documents proposes the tokens of several of its different
    sets; the proposals are summed over all documents.  A token that misses
    the table only loses its place in the orders, never a link."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        n = 0

        def propose():
            tok, c = np.unique(np.concatenate(list(held.values())), return_counts=True)
            keep = c >= HEAVY_LEAST
            return pa.RecordBatch.from_arrays(
                [pa.array(tok[keep].view(np.int64)), pa.array(c[keep])], names=["token", "c"])
        for b in batches:
            for t in b.column(0):
                u = S.shingle_set(t.as_py(), k)
                held[S.set_digest(u)] = u
                n += 1
                if n == HEAVY_BATCH:
                    yield propose()
                    held, n = {}, 0
        if n:
            yield propose()

    top = (texts.select("text").mapInArrow(count, "token bigint, c bigint")
           .groupBy("token").agg(F.sum("c").alias("c"))
           .orderBy(F.desc("c"), "token").limit(HEAVY_MAX).collect())
    tok = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    cls = np.array([int(r["c"]).bit_length() for r in top], np.uint64)
    at = np.argsort(tok)
    return np.stack([tok[at], cls[at]])


def _ranks(u: np.ndarray, heavy: np.ndarray, order: int) -> np.ndarray:
    """Position of tokens in a global order: rare ones first, by frequency
    class; within a class by a hash of the order."""
    o = S.mix(u, order + 1) >> np.uint64(6)
    if heavy.shape[1] and len(u):
        at = np.minimum(np.searchsorted(heavy[0], u), heavy.shape[1] - 1)
        o |= np.where(heavy[0][at] == u, heavy[1][at], np.uint64(0)) << np.uint64(58)
    return o


def _prefix_len(n: int, pct: int) -> int:
    return n + (-pct * n // 100) + 1


def _prefix(u: np.ndarray, heavy: np.ndarray, order: int, pct: int) -> np.ndarray:
    p = _prefix_len(len(u), pct)
    return u[np.argsort(_ranks(u, heavy, order))[:p]]


def _parity(u: np.ndarray) -> bytes:
    """Parity of the tokens in every cell of a hash table with at least as
    many cells as tokens.  Sizes are powers of two, so XOR of its halves turns
    a sketch into the one of half the size."""
    bits = max(PARITY_BITS, 1 << (len(u) - 1).bit_length())
    cell = (S.mix(u, 99) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Sketches:
    """Parity sketches of a task step, by size, and their folded forms."""

    def __init__(self, packed: list[bytes]):
        self.size = np.array([len(x) for x in packed], np.int64)
        self.row = np.zeros(len(packed), np.int64)
        self.by: dict[tuple[int, int], np.ndarray] = {}
        for c in np.unique(self.size):
            at = np.flatnonzero(self.size == c)
            self.row[at] = np.arange(len(at))
            self.by[int(c), int(c)] = np.frombuffer(
                b"".join([packed[k] for k in at]), np.uint64).reshape(len(at), -1)

    def folded(self, size: int, to: int) -> np.ndarray:
        got = self.by.get((size, to))
        if got is None:
            big = self.folded(size, to * 2)
            half = big.shape[1] // 2
            got = self.by[size, to] = big[:, :half] ^ big[:, half:]
        return got

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bound of the symmetric difference of the sets i[k] and j[k]."""
        i, j = np.broadcast_arrays(i, j)
        out = np.zeros(len(j), np.int64)
        classes = self.size[i] * (1 << 32) + self.size[j]
        for c in np.unique(classes):
            at = np.flatnonzero(classes == c)
            a, b = int(c) >> 32, int(c) & 0xFFFFFFFF
            to = min(a, b)
            x = self.folded(a, to)[self.row[i[at]]] ^ self.folded(b, to)[self.row[j[at]]]
            out[at] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return out


def features(texts: DataFrame, k: int, pct: int, heavy: np.ndarray) -> DataFrame:
    """Size, set digest, first token per hash order, parity sketch and the
    prefix under the first rare-first order of every text that has words."""
    table = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv = table.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6 + ORDERS)]
            for i, t in zip(b.column(0), b.column(1), strict=True):
                u = S.shingle_set(t.as_py(), k)
                if not len(u):
                    continue
                s1, s2 = S.set_digest(u)
                first = [S.signed(int(u[S.mix(u, r + 1).argmin()])) for r in range(ORDERS)]
                vals = [i.as_py(), len(u), s1, s2, *first, _parity(u),
                        _prefix(u, hv, 0, pct).view(np.int64)]
                for c, v in zip(cols, vals, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * (2 + ORDERS), pa.binary(),
                     pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=[x.split()[0] for x in FEATS.split(", ")])

    return texts.mapInArrow(run, FEATS)


def _most_apart(a, b, pct: int):
    """Largest symmetric difference of linked sets of sizes a and b."""
    both = a + b
    return both + 2 * (-pct * both // (100 + pct))


def _linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= pct * (len(both) - common)


def _blocks(rows: DataFrame, key: str, cost_rows: int) -> DataFrame:
    """Rows of buckets with two or more members, dealt to block pairs: columns
    ``bi, bj`` (blocks) and ``grp`` (which task step compares them)."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("m")).filter("m > 1")
    nb = F.ceil(F.col("m") / BLOCK).cast("int")
    r = rows.join(sizes, key).withColumn("nb", nb)
    r = r.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    r = (r.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
         .drop("other", "nb", "m"))
    total = sizes.agg(F.sum(F.col("m") * nb)).first()[0] or 0
    groups = max(1, total // cost_rows)
    return r.withColumn("grp", F.pmod(F.xxhash64(key, "bi", "bj"), F.lit(groups)))


def _buckets(t: pa.Table, key: str) -> Iterator[np.ndarray]:
    """Row numbers of every (bucket, block pair) of a task step."""
    k, bi, bj = (t.column(c).to_numpy() for c in (key, "bi", "bj"))
    order = np.lexsort((t.column("id").to_numpy(), bj, bi, k))
    k, bi, bj = k[order], bi[order], bj[order]
    edge = np.flatnonzero((k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    for part in np.split(order, edge):
        if len(part) > 1:
            yield part


def _near(i: int, idx: np.ndarray, n: np.ndarray, par: _Sketches, pct: int) -> np.ndarray:
    """Members after position i of a bucket whose size and parity allow a link."""
    rest = idx[i + 1:]
    a, b = n[idx[i]], n[rest]
    ok = (np.maximum(a, b) * pct <= 100 * np.minimum(a, b))
    rest = rest[ok]
    return rest[par.apart(idx[i], rest) <= _most_apart(a, n[rest], pct)] if len(rest) else rest


def _in_steps(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.groupBy("grp").applyInArrow(fn, schema)


def _maybe_linked(reps: DataFrame, pct: int) -> DataFrame:
    """Ids that have a possible partner in a bucket of the first order."""
    def run(t: pa.Table) -> pa.Table:
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        par, out = _Sketches(t.column("parity").to_pylist()), []
        for idx in _buckets(t, "k0"):
            for i in range(len(idx) - 1):
                near = _near(i, idx, n, par, pct)
                if len(near):
                    out.append(ids[idx[i:i + 1]])
                    out.append(ids[near])
        got = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return pa.table({"id": pa.array(got, pa.int64())})

    rows = _blocks(reps.select("id", "n", "k0", "parity"), "k0", GROUP_ROWS)
    return _in_steps(rows, run, "id bigint").distinct()


def _packed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Replaces the text column by the packed shingle set."""
    for b in batches:
        at = b.schema.get_field_index("text")
        packed = pa.array([S.shingle_set(t.as_py(), k).tobytes() for t in b.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [packed if c == at else b.column(c) for c in range(b.num_columns)],
            names=["packed" if c == at else n for c, n in enumerate(b.schema.names)])


def _sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The packed shingle sets of the named documents."""
    own = texts.join(ids, "id", "left_semi").dropDuplicates(["id"])
    return own.mapInArrow(lambda b: _packed(b, k), "id bigint, packed binary")


def _first_links(reps: DataFrame, ids: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """Spanning links inside the buckets of the first order, among ``ids``."""
    def run(t: pa.Table) -> pa.Table:
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        par = _Sketches(t.column("parity").to_pylist())
        packed = [np.frombuffer(x, np.uint64) for x in t.column("packed").to_pylist()]
        a, b = [], []
        for idx in _buckets(t, "k0"):
            root = {int(x): int(x) for x in idx}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x
            for i in range(len(idx) - 1):
                me = int(idx[i])
                for o in _near(i, idx, n, par, pct):
                    ra, rb = find(me), find(int(o))
                    if ra != rb and _linked(packed[me], packed[o], pct):
                        root[rb] = ra
                        a.append(ids[me])
                        b.append(ids[o])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = _blocks(reps.select("id", "n", "k0", "parity").join(ids, "id", "left_semi"), "k0", GROUP_ROWS)
    rows = texts.join(stored(rows.select("id", "n", "k0", "bi", "bj", "grp", "parity"), "blocks"), "id")
    sets = rows.mapInArrow(lambda b: _packed(b, k), "id bigint, packed binary, n int, k0 bigint, "
                           "bi int, bj int, grp bigint, parity binary")
    return _in_steps(sets, run, "a bigint, b bigint")


def _met(r: int) -> str:
    """SQL: the pair (x, y) met in a bucket of an order below ``r``."""
    return " OR ".join(f"x.k{j} = y.k{j}" for j in range(r)) or "false"


def _other_bucket_pairs(reps: DataFrame, r: int, pct: int) -> DataFrame:
    """Possible links of unconnected sets in the buckets of order ``r`` that
    met under no earlier order."""
    keys = [f"k{j}" for j in range(r + 1)]

    def run(t: pa.Table) -> pa.Table:
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        comp, par = t.column("comp").to_numpy(), _Sketches(t.column("parity").to_pylist())
        ks = [t.column(c).to_numpy() for c in keys[:-1]]
        a, b = [], []
        for idx in _buckets(t, keys[-1]):
            if (comp[idx] == comp[idx[0]]).all():
                continue
            for i in range(len(idx) - 1):
                near = _near(i, idx, n, par, pct)
                near = near[comp[near] != comp[idx[i]]]
                for kk in ks:
                    near = near[kk[near] != kk[idx[i]]]
                a.append(np.full(len(near), ids[idx[i]]))
                b.append(ids[near])
        cat = (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(cat[0], pa.int64()), "b": pa.array(cat[1], pa.int64())})

    rows = _blocks(reps.select("id", "n", "comp", *keys, "parity"), keys[-1], GROUP_ROWS)
    return _in_steps(rows, run, "a bigint, b bigint")


def _prefix_pairs(feats: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """Unconnected pairs that share a prefix token of the first order and met
    under no order (the rest that makes the join exact)."""
    tokens = feats.select("id", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    keys = [f"k{r}" for r in range(ORDERS)]
    rows = tokens.join(shared, "token").join(reps.select("id", "n", "comp", *keys), "id")
    cond = (f"x.token = y.token AND x.id < y.id AND x.comp <> y.comp "
            f"AND x.n * {pct} <= y.n * 100 AND y.n * {pct} <= x.n * 100 AND NOT ({_met(ORDERS)})")
    return rows.alias("x").join(rows.alias("y"), F.expr(cond)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _check_pairs(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, pct: int,
                 heavy: np.ndarray) -> DataFrame:
    """The pairs that are links: parity, then shared prefixes under the other
    orders, then the sets themselves."""
    table = texts.sparkSession.sparkContext.broadcast(heavy)
    par = reps.select("id", "n", "parity")
    both = (pairs.join(par.toDF("a", "na", "pa"), "a").join(par.toDF("b", "nb", "pb"), "b"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            na, nb = (t.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            par, m = _Sketches(t.column("pa").to_pylist() + t.column("pb").to_pylist()), t.num_rows
            d = par.apart(np.arange(m), np.arange(m, 2 * m))
            ok = pa.array(d <= _most_apart(na, nb, pct))
            yield t.select(["a", "b"]).filter(ok)

    left = stored(both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(
        sketch, "a bigint, b bigint"), "pairs")
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    sets = _sets(texts, stored(ids, "ids"), k)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hv = table.value
        for t in batches:
            keep = []
            for x, y in zip(t.column("sa"), t.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(all(
                    len(np.intersect1d(_prefix(x, hv, r, pct), _prefix(y, hv, r, pct), True))
                    for r in range(1, 3)) and _linked(x, y, pct))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = (left.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
            .select("a", "b", "sa", "sb"))
    return full.mapInArrow(verify, "a bigint, b bigint")


def _with_comp(reps: DataFrame, links: DataFrame) -> DataFrame:
    comp = components(links)
    return stored(reps.join(comp.toDF("id", "c"), "id", "left")
                  .withColumn("comp", F.coalesce("c", "id")).drop("c"), "reps")


def link_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                 pct: int = 80) -> DataFrame:
    """id, n_shingles, component_id of every row: documents whose ``k``-word
    shingle sets have 100 |A & B| >= ``pct`` |A | B| are linked, and a class
    carries the smallest id reachable by links."""
    texts = _texts(df, id_col, text_col)
    heavy = heavy_tokens(texts, k)
    feats = stored(features(texts, k, pct, heavy), "shingles")
    first = feats.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    lead = first.select(F.col("rep").alias("id"))
    small = stored(feats.drop("prefix", "s1", "s2").join(lead, "id", "left_semi")
                   .dropDuplicates(["id"]), "leads")
    links = stored(_first_links(small, stored(_maybe_linked(small, pct), "ids"), texts, k, pct), "links")
    ranked = _with_comp(small, links)
    pairs = _prefix_pairs(feats, ranked, pct)
    for r in range(1, ORDERS):
        pairs = pairs.union(_other_bucket_pairs(ranked, r, pct))
    more = _check_pairs(stored(pairs.distinct(), "pairs"), ranked, texts, k, pct, heavy)
    comp = components(links.union(stored(more, "links")))
    own = (feats.select("id", "n", "s1", "s2").join(first, ["s1", "s2"])
           .join(comp.toDF("rep", "c"), "rep", "left")
           .select("id", "n", F.coalesce("c", "rep").alias("c")).dropDuplicates(["id"]))
    base = df.select(F.col(id_col).cast("bigint").alias("id"))
    return base.join(own, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"),
        F.coalesce("c", "id").alias("component_id"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table (3 words, 90 %)."""
    from .common import table
    return link_classes(table(spark, sf_dir, "documents"), k=3, pct=90)


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT t FROM s GROUP BY t HAVING count(*) > 1),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN rare USING (t) JOIN s b ON b.t = a.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
  WHERE 100 * o.c >= 90 * (x.n + y.n - o.c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id"""
