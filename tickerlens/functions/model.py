"""Model-output decoding as Column expressions.

Logits and attention arrive as arrays; everything here is higher-order
array functions evaluated in the JVM, so any scorer that emits arrays gets
the same decode semantics without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label_text

# --- fixed values -----------------------------------------------------------
TOKEN_PATTERN = r"[ \t\n\x0B\f\r]+"   # whitespace gaps for tokenisation
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_logits(logits: Column | str) -> Column:
    """struct(pred INT, label STRING, confidence DOUBLE).

    Softmax is shifted by the max for stability; the predicted class is the
    first index holding the max logit; confidence is that class's softmax
    probability, ``1 / sum(exp(x - max))``.
    """
    a = _col(logits).cast("array<double>")
    m = F.array_max(a)
    denom = F.aggregate(F.transform(a, lambda x: F.exp(x - m)), F.lit(0.0),
                        lambda acc, x: acc + x)
    pred = (F.array_position(a, m) - 1).cast("int")
    return F.struct(pred.alias("pred"), label_text(pred).alias("label"),
                    (F.lit(1.0) / denom).alias("confidence"))


def mean_over_heads(attention: Column | str) -> Column:
    """Element-wise mean of ``heads x seq`` rows (array<array<double>>)."""
    att = _col(attention).cast("array<array<double>>")
    n = F.size(att)
    zero = F.array_repeat(F.lit(0.0), F.size(F.element_at(att, 1)))
    total = F.aggregate(att, zero,
                        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def _best(tokens: Column, weights: Column, length: Column, keep=None) -> Column:
    """Argmax over positions 2..length-1 (1-based: skip [CLS], [SEP] and
    right padding) as struct(w, neg_i, tok).  Ties go to the first position.
    ``keep`` filters the candidate tokens; NULL without candidates."""
    idx = F.sequence(F.lit(2), length - 1)
    cands = F.transform(idx, lambda i: F.struct(
        F.element_at(weights, i).alias("w"), (-i).alias("neg_i"),
        F.element_at(tokens, i).alias("tok")))
    if keep is not None:
        cands = F.filter(cands, lambda s: keep(s["tok"]))
    return F.when(length > 2, F.array_max(cands))


def token_keyword(token: Column) -> Column:
    """The winning token without its leading '#'."""
    return F.regexp_replace(token, r"^#+", "")


def _best_token(tokens: Column, weights: Column, length: Column,
                keep=None) -> Column:
    """Token of ``_best`` without its leading '#'."""
    return token_keyword(_best(tokens, weights, length, keep)["tok"])


def best_of_window(tokens: Column | str, attention: Column | str, length: Column | str,
                   window: Column | str) -> Column:
    """Most-attended non-special token of one window as struct(w, neg_window,
    neg_i, tok): the largest struct of a headline's windows is the best of all
    its tokens, and ties go to the first window and position.  NULL when the
    window holds only [CLS] and [SEP]."""
    b = _best(_col(tokens), mean_over_heads(attention), _col(length).cast("int"))
    return F.when(b.isNotNull(), F.struct(b["w"].alias("w"), (-_col(window)).alias("neg_window"),
                                          b["neg_i"].alias("neg_i"), b["tok"].alias("tok")))


def attention_keyword(tokens: Column | str, attention: Column | str,
                      length: Column | str) -> Column:
    """most-attended non-special token of the CLS row; NULL when the
    sequence holds only [CLS] and [SEP]."""
    return _best_token(_col(tokens), mean_over_heads(attention),
                       _col(length).cast("int"))


def keyword_without_stopwords(tokens: Column | str, attention: Column | str,
                              length: Column | str, stopwords: list[str]) -> Column:
    """Like F12 but stop words (after '#' strip, lower-case) never win.
    NULL when every candidate is a stop word."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])

    def keep(tok):
        return ~F.array_contains(stop, F.lower(F.regexp_replace(tok, r"^#+", "")))

    return _best_token(_col(tokens), mean_over_heads(attention),
                       _col(length).cast("int"), keep)


def word_tokens(text: Column | str) -> Column:
    """Lower-case whitespace tokens (same split as the MLlib RegexTokenizer
    used by the classifier), empty tokens removed."""
    parts = F.split(F.lower(_col(text)), TOKEN_PATTERN)
    return F.filter(parts, lambda t: F.length(t) >= 1)


def wordpiece_frame(words: Column, max_len: int) -> tuple[Column, Column]:
    """Tokens ``[CLS] w1 .. wk [SEP]`` padded with [PAD] to ``max_len`` and the
    unpadded length, the layout a sequence classifier sees; ``words`` are the
    at most ``max_len - 2`` tokens of one window."""
    toks = F.concat(F.array(F.lit(CLS)), words, F.array(F.lit(SEP)))
    length = F.size(toks)
    padded = F.concat(toks, F.array_repeat(F.lit(PAD), F.lit(max_len) - length))
    return padded, length
