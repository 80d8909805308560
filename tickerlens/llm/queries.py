"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .chat_prefs import OP5_SQL, op5_chat_preferences
from .cotrain import op2_cotraining
from .cross_align import op11_cross_alignment
from .debruijn import OP3_SQL, op3_substring_dedup
from .decontam import op7_decontamination
from .html_wrapper import op1_html_wrapper
from .importance import OP13_SQL, op13_importance_resampling
from .jaccard_orders import OP4_SQL, op4_ngram_jaccard
from .line_dedup import OP10_SQL, op10_line_dedup
from .quality_rules import OP8_SQL, op8_quality_rules
from .token_counts import op12_token_counts
from .toxicity import op6_toxicity

QUERIES = {
    "op2_cotraining": op2_cotraining,
    "op1_html_wrapper": op1_html_wrapper,
    "op5_chat_preferences": op5_chat_preferences,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op11_cross_alignment": op11_cross_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op5_chat_preferences": OP5_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op10_line_dedup": OP10_SQL,
    "op8_quality_rules": OP8_SQL,
    "op13_importance_resampling": OP13_SQL,
}
