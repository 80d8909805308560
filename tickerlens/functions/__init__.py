"""Scalar Column functions (native expressions, no Python per row)."""

from .model import (attention_keyword, decode_logits, keyword_without_stopwords,
                    mean_over_heads, word_tokens, wordpiece_frame)
from .numeric import guarded_log_ratio, round6, safe_bigint, safe_double
from .text import (LABELS, clean_title, headline_hash, label_id, label_text,
                   pct_bar, polarity, source_of, split_last, thousands,
                   title_kept, title_kept_raw, url_netloc, ustrip)
from .time import (days_from, in_trading_hours, iso_seconds_z, parse_iso_utc,
                   session_date, session_date_ts)

__all__ = [
    "LABELS", "attention_keyword", "clean_title", "days_from", "decode_logits",
    "guarded_log_ratio", "headline_hash", "in_trading_hours", "iso_seconds_z",
    "keyword_without_stopwords", "label_id", "label_text", "mean_over_heads",
    "parse_iso_utc", "pct_bar", "polarity", "round6", "safe_bigint",
    "safe_double", "session_date", "session_date_ts", "source_of",
    "split_last", "thousands", "title_kept", "title_kept_raw", "url_netloc", "ustrip",
    "word_tokens", "wordpiece_frame",
]
