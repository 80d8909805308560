"""Text scalar functions.

All of these are native Column expressions so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's str.strip() whitespace set, written as one explicit character class
# so that the JVM regex engine and RE2 (DuckDB oracle) read it the same way:
# TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD..HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP,
# MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
WS_CLASS = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# the same characters as a set for the native trim
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Sentiment classes: id <-> text (0 negative, 1 neutral, 2 positive).
LABELS = ("negative", "neutral", "positive")
# Title placeholder used by the feed for deleted articles (compared lower-case).
REMOVED_TITLE = "[removed]"
# Source used when an article has neither a source name nor a URL.
DEFAULT_SOURCE = "newsapi"
# Authority part of a URL: optional scheme, then '//' and up to / ? #.
NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """strip leading/trailing Unicode whitespace like ``str.strip()``."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def headline_hash(c: Column | str) -> Column:
    """hex SHA-256 of the stripped UTF-8 text (case-sensitive)."""
    return F.sha2(ustrip(c), 256)


def clean_title(c: Column | str) -> Column:
    """P1 projection: NULL -> '' then strip."""
    return ustrip(F.coalesce(_col(c), F.lit("")))


def title_kept(cleaned: Column | str) -> Column:
    """P1 predicate on a cleaned title: not empty and not '[removed]'."""
    t = _col(cleaned)
    return (t != F.lit("")) & (F.lower(t) != F.lit(REMOVED_TITLE))


# A raw title that P1 drops: only whitespace, or '[removed]' (any ASCII case)
# with whitespace around it.  \z is the true end of input.
DROPPED_TITLE_PATTERN = rf"^{WS_CLASS}*(?i:\[removed\])?{WS_CLASS}*\z"


def title_kept_raw(raw: Column | str) -> Column:
    """P1 predicate on the *uncleaned* title, equal to
    ``title_kept(clean_title(raw))``: the anchored pattern fails at the first
    character that is neither whitespace nor part of '[removed]', so long
    titles are not stripped or lower-cased just to be tested."""
    return ~F.coalesce(_col(raw), F.lit("")).rlike(DROPPED_TITLE_PATTERN)


def url_netloc(url: Column | str) -> Column:
    """Authority of a URL ('' when there is no '//' part)."""
    return F.regexp_extract(_col(url), NETLOC_PATTERN, 1)


def source_of(name: Column | str, url: Column | str,
              strip_mode: str = "charset") -> Column:
    """source identifier from the feed's source name or the article URL.

    ``strip_mode="charset"`` removes every leading 'w' and '.' (parity with a
    character-set lstrip, so ``www.wired.com`` -> ``ired.com``);
    ``"prefix"`` removes one leading ``www.`` only.
    """
    if strip_mode not in ("charset", "prefix"):
        raise ValueError(f"unknown strip_mode {strip_mode!r}")
    n = F.coalesce(_col(name), F.lit(""))
    u = F.coalesce(_col(url), F.lit(""))
    netloc = url_netloc(u)
    # An unbalanced IPv6 bracket is a parse error -> default source.
    bad_bracket = netloc.contains("[") != netloc.contains("]")
    strip_re = r"^[w.]+" if strip_mode == "charset" else r"^www\."
    stripped = F.regexp_replace(netloc, strip_re, "")
    return (F.when(n != "", F.replace(F.lower(n), F.lit(" "), F.lit("-")))
            .when((u != "") & ~bad_bracket, stripped)
            .otherwise(F.lit(DEFAULT_SOURCE)))


def label_id(text: Column | str) -> Column:
    """label text (any case, padded) -> 0/1/2, NULL when unknown."""
    m = F.create_map(*[x for i, name in enumerate(LABELS)
                       for x in (F.lit(name), F.lit(i))])
    return F.try_element_at(m, F.lower(ustrip(text)))


def label_text(idx: Column | str) -> Column:
    """0/1/2 -> label text."""
    arr = F.array(*[F.lit(x) for x in LABELS])
    return F.get(arr, _col(idx).cast("int"))


def polarity(label: Column | str) -> Column:
    """-1 / 0 / +1 for negative / neutral / positive label text."""
    lab = _col(label)
    return (F.when(lab == "negative", F.lit(-1))
            .when(lab == "neutral", F.lit(0))
            .when(lab == "positive", F.lit(1)))


def split_last(c: Column | str, delim: str = "@") -> tuple[Column, Column]:
    """split on the last delimiter -> (before, after); NULLs if absent."""
    x = _col(c)
    has = x.contains(delim)
    after = F.substring_index(x, delim, -1)
    before = F.left(x, F.char_length(x) - F.char_length(after) - len(delim))
    return F.when(has, before), F.when(has, after)


def pct_bar(pct: Column | str, glyph: str = "█") -> Column:
    """text bar of ``int(pct / 2)`` glyphs."""
    return F.repeat(F.lit(glyph), F.floor(_col(pct) / 2).cast("int"))


def thousands(c: Column | str) -> Column:
    """integer with thousands separators."""
    return F.format_number(_col(c), 0)
