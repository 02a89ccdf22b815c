"""The thirteen training-data queries."""

from __future__ import annotations

from .ann import op7_ann_search
from .chat_format import op2_chat_format
from .decontaminate import op6_decontamination
from .fill_in_middle import op12_fill_in_middle
from .jaccard_join import op8_jaccard_join
from .language_id import op13_language_id
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import op5_best_fit_packing
from .prefix_trie import op11_prefix_trie
from .quality import op4_quality
from .secret_scan import op10_secret_scan
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op3_token_counts
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_chat_format, op3_token_counts, op4_quality, op5_best_fit_packing, op6_decontamination, op7_ann_search, op8_jaccard_join, op9_toxicity, op10_secret_scan, op11_prefix_trie, op12_fill_in_middle, op13_language_id)}
