"""Substring dedup by De Bruijn compaction of token k-mers.

Every run of ``k`` words is an edge between its first and its last ``k - 1``
words.  Edges that follow each other in a text and share their anchor (the
least-hashed short gram inside the ``k`` words, a function of the content) are
one unbranched piece of path and travel as one row; equal paths in two texts
cut into equal pieces except at their ends.  Steps, all of them Spark joins
and pre-aggregated groupings:

1. path pieces of every text, written once, and the anchors that occur in two
   documents or more (most do not, and their paths leave the job here);
2. pieces around the remaining anchors, each with the smallest source
   coordinate (document, row, word) of its content; the row is a digest of the
   text, as rows that share an id may hold different texts;
3. anchors with a single piece are unbranched: the piece's source holds for
   all its edges.  At a branching anchor the pieces are opened into their
   edges, and every edge gets its own smallest source;
4. consecutive edges of a document with consecutive source coordinates compact
   to long spans; the words at the source coordinates are digested (128 bits)
   and a span is removed only if the document's own words agree.

Rows per anchor are minima and joins, so an anchor that a third of all
documents share is combined before the shuffle and its join may be split.
What is collected per document is bounded by the document itself.

Defined results: words are judged on the input, in every text; a NULL text
has no words; fewer than ``k`` words are never removed; of equal texts the one
with the smallest id stays; rows that repeat one id do not remove each other,
and every one of them is a source with its own text; a row with a NULL id has
no place in the order, so it loses nothing and is no source; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import stored

# --- fixed values -----------------------------------------------------------
ANCHOR_WORDS = 6              # words of an anchor gram (less than k)
LOW = np.uint64((1 << 28) - 1)  # position bits of an anchor choice
# ---------------------------------------------------------------------------


def _paths(text: bytes | None, k: int):
    """Edge hashes of a text and its path pieces: first edge, number of edges,
    anchor and content hash of each."""
    wh = S.word_hashes(S.split_words(text))
    if len(wh) < k:
        return None
    edges, grams = S.window_hashes(wh, k, min(ANCHOR_WORDS, k - 1))
    # least gram inside each edge, the leftmost of equal ones: hash bits above,
    # position below, and a sliding minimum by doubling
    at = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width, have = len(grams) - len(edges) + 1, 1
    while have < width:
        step = min(have, width - have)
        at = np.minimum(at[:len(at) - step], at[step:])
        have += step
    at = (at & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(first, len(edges)))
    # a piece has fewer than k edges, so its first and last edge cover its words
    piece = S.mix(edges[first] * S.MIX_A + S.mix(edges[first + n - 1], 5) + n.astype(np.uint64), 3)
    return edges, first, n, grams[at[first]], piece


def _pieces(docs: DataFrame, k: int) -> DataFrame:
    """All path pieces of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, t, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                got = _paths(t.as_py(), k)
                if got is None:
                    continue
                _, first, n, mark, piece = got
                for c, v in zip(out, (piece.view(np.int64), mark.view(np.int64),
                                      np.full(len(n), i, np.int64), np.full(len(n), r, np.int64),
                                      first.astype(np.int32), n.astype(np.int32)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["piece", "mark", "doc", "row", "at", "n"])
    return docs.mapInArrow(run, "piece bigint, mark bigint, doc bigint, row bigint, at int, n int")


def _edges_at(ws: list[bytes], at: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Edge hashes of a text, right where the pieces (``at``, ``n``) lie: only
    their words are hashed, they are few."""
    change = np.zeros(len(ws) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n + k - 1, -1)
    need = np.flatnonzero(np.cumsum(change)[:-1])
    wh = np.zeros(len(ws), np.uint64)
    wh[need] = S.word_hashes([ws[i] for i in need.tolist()])
    return S.window_hashes(wh, k)[0]


def _opened(asked: DataFrame, k: int) -> DataFrame:
    """The edges of branching pieces, read at their source coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, r, t, q in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(),
                                  b.column("text"), b.column("q"), strict=True):
                at, n, piece = (q.values.field(c).to_numpy(zero_copy_only=False)
                                for c in ("at", "n", "piece"))
                n = n.astype(np.int64)
                edges = _edges_at(S.split_words(t.as_py()), at, n, k)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(at, n) + inner
                for c, v in zip(out, (edges[pos].view(np.int64), np.repeat(piece, n),
                                      inner.astype(np.int32), np.full(len(pos), i, np.int64),
                                      np.full(len(pos), r, np.int64), pos.astype(np.int32)),
                                strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["edge", "piece", "k", "doc", "row", "at"])
    return asked.mapInArrow(run, "edge bigint, piece bigint, k int, doc bigint, row bigint, at int")


def _spans(hits: DataFrame, k: int) -> DataFrame:
    """Long spans of a row: runs of edges whose source coordinates run along,
    as (doc, row, src, srow, sat, words) with all first words ``ats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, row, hs in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(),
                                    b.column("hs"), strict=True):
                v = hs.values
                at, n, src, srow, sat = (
                    v.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in ("at", "n", "src", "srow", "sat"))
                o = np.lexsort((sat, srow, src, at))
                at, n, src, srow, sat = at[o], n[o], src[o], srow[o], sat[o]
                new = np.concatenate(([True], (src[1:] != src[:-1]) | (srow[1:] != srow[:-1])
                                      | (sat[1:] - at[1:] != sat[:-1] - at[:-1])
                                      | (at[1:] > at[:-1] + n[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                same: dict[tuple[int, int, int, int], list[int]] = {}
                for x in zip(src[first].tolist(), srow[first].tolist(), sat[first].tolist(),
                             (at[last] + n[last] - at[first] + k - 1).tolist(),
                             at[first].tolist(), strict=True):
                    same.setdefault(x[:4], []).append(x[4])
                for key, ats in same.items():
                    for col, x in zip(out, (doc, row, *key, ats), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 6, pa.list_(pa.int64())),
                                                strict=True)],
                names=["doc", "row", "src", "srow", "sat", "words", "ats"])
    return hits.mapInArrow(run, "doc bigint, row bigint, src bigint, srow bigint, sat bigint, "
                                "words bigint, ats array<bigint>")


def _digest(ws: list[bytes], at: int, n: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws[at:at + n]))


def _source_digests(asked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, r, t, q in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(),
                                  b.column("text"), b.column("q").to_pylist(), strict=True):
                ws = S.split_words(t.as_py())
                for x in q:
                    for c, v in zip(out, (i, r, x["sat"], x["words"],
                                          _digest(ws, x["sat"], x["words"])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary()),
                                                strict=True)],
                names=["src", "srow", "sat", "words", "digest"])
    return asked.mapInArrow(run, "src bigint, srow bigint, sat bigint, words bigint, digest binary")


def _remove(docs: DataFrame) -> DataFrame:
    """doc, n_words, n_removed and the kept words of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, t, q in zip(b.column("doc").to_pylist(), b.column("text"),
                               b.column("q").to_pylist(), strict=True):
                ws = S.split_words(t.as_py())
                kept = ws
                if q:
                    gone = np.zeros(len(ws) + 1, bool)
                    for x in q:
                        for at in x["ats"]:
                            if _digest(ws, at, x["words"]) == x["digest"]:
                                gone[at:at + x["words"]] = True
                    kept = [w for w, g in zip(ws, gone.tolist(), strict=False) if not g]
                for c, v in zip(out, (i, len(ws), len(ws) - len(kept), b" ".join(kept)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                                                strict=True)],
                names=["doc", "n_words", "n_removed", "kept"])
    return docs.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept binary")


def repeated_spans(docs: DataFrame, k: int) -> DataFrame:
    """src, srow, sat, words, doc, row, ats, digest: spans of ``docs(doc, text,
    row)`` whose every run of ``k`` words also starts in a document with a
    smaller id, with the digest of the words at the source coordinates."""
    docs = docs.filter(F.col("doc").isNotNull())
    # texts are hashed once; the written pieces serve the count and the join
    pieces = stored(_pieces(docs, k), "all-pieces")
    shared = pieces.groupBy("mark").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = stored(shared.filter("lo < hi").select("mark"), "anchors")
    pieces = stored(pieces.join(shared, "mark"), "pieces")
    source = pieces.groupBy("piece").agg(F.min(F.struct("doc", "row", "at")).alias("s"),
                                         F.min("mark").alias("mark"), F.min("n").alias("n"))
    source = stored(source, "sources")
    fans = source.groupBy("mark").agg(F.count("*").alias("fan"))
    source = stored(source.join(fans, "mark").select("piece", "s", "n", "fan"), "fans")
    # edges of the pieces at branching anchors, each with its own source
    asked = source.filter("fan > 1").groupBy(F.col("s.doc").alias("doc"),
                                               F.col("s.row").alias("row")).agg(
        F.collect_list(F.struct(F.col("s.at").alias("at"), "n", "piece")).alias("q"))
    edges = stored(_opened(docs.join(asked, ["doc", "row"]), k), "edges")
    edge_source = edges.groupBy("edge").agg(F.min(F.struct("doc", "row", "at")).alias("s"))
    opened = (edges.join(edge_source, "edge").groupBy("piece")
              .agg(F.collect_list(F.struct("k", F.col("s.doc").alias("src"), F.col("s.row").alias("srow"),
                                           F.col("s.at").alias("sat"))).alias("es")))
    plain = source.filter("fan = 1").select(
        "piece", F.array(F.struct(F.lit(0).alias("k"), F.col("n").alias("n"),
                                  F.col("s.doc").alias("src"), F.col("s.row").alias("srow"),
                                  F.col("s.at").alias("sat"))).alias("es"))
    opened = opened.select("piece", F.transform("es", lambda e: F.struct(
        e["k"].alias("k"), F.lit(1).alias("n"), e["src"].alias("src"), e["srow"].alias("srow"),
        e["sat"].alias("sat"))).alias("es"))
    table = stored(plain.union(opened), "edge-sources")
    own = pieces.select("piece", "doc", "row", "at").join(table, "piece")
    older = F.filter("es", lambda e: e["src"] < F.col("doc"))
    hits = own.select("doc", "row", F.transform(older, lambda e: F.struct(
        (F.col("at") + e["k"]).alias("at"), e["n"].alias("n"), e["src"].alias("src"),
        e["srow"].alias("srow"), e["sat"].alias("sat"))).alias("hs")).filter(F.size("hs") > 0)
    hits = hits.groupBy("doc", "row").agg(F.flatten(F.collect_list("hs")).alias("hs"))
    spans = stored(_spans(hits, k), "spans")
    wanted = spans.select("src", "srow", "sat", "words").distinct().groupBy(
        F.col("src").alias("doc"), F.col("srow").alias("row")).agg(
        F.collect_list(F.struct("sat", "words")).alias("q"))
    digests = stored(_source_digests(docs.join(wanted, ["doc", "row"])), "digests")
    return spans.join(digests, ["src", "srow", "sat", "words"])


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   k: int = 13) -> DataFrame:
    """id, n_words, n_removed and ``kept`` (the words left, joined by one
    space, UTF-8 bytes) of every row of ``df``."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"),
                     F.col(text_col).cast("string").cast("binary").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))
    spans = stored(repeated_spans(docs, k).groupBy("doc", "row").agg(
        F.collect_list(F.struct("ats", "words", "digest")).alias("q")), "removals")
    return _remove(docs.join(spans, ["doc", "row"], "left")).withColumnRenamed("doc", id_col)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract rows of the whole ``documents`` table."""
    from .common import table
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13) x),
old AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) x
  WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM old, range(13) r(j)),
word AS (SELECT doc_id, i, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t) x),
kept AS (
  SELECT a.doc_id, count(g.i) AS n_removed,
         string_agg(a.w, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM word a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN kept k ON k.doc_id = t.doc_id"""
