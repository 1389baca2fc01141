"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from .bpe import op9_bpe
from .curve_search import op3_curve_search
from .hidden_markov import op4_hidden_markov
from .license_scan import op5_license_scan
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import op10_mixing
from .near_jaccard import op6_ngram_jaccard
from .rule_quality import op2_rule_quality
from .url_filters import OP1_SQL, op1_url_filters
from .vector_dedup import OP7_SQL, op7_embedding_dedup

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_rule_quality": op2_rule_quality,
    "op3_curve_search": op3_curve_search,
    "op4_hidden_markov": op4_hidden_markov,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_mixing": op10_mixing,
}
#: Where there is none, tests compare with brute force, a round trip or held-out accuracy.
SQL = {"op1_url_filters": OP1_SQL, "op7_embedding_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL}
