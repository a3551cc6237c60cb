"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .byte_bpe import op5_byte_bpe
from .language_id import op1_language_id
from .pii_spans import op2_pii_spans
from .quality_rules import op7_quality_rules
from .secret_scan import op9_secret_scan
from .simhash_fingerprints import op8_simhash_fingerprints
from .simhash_neardup import op6_simhash_neardup
from .source_mixing import OP10_SQL, op10_source_mixing
from .token_counts import op4_token_counts
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii_spans": op2_pii_spans,
    "op3_url_filter": op3_url_filter,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_fingerprints": op8_simhash_fingerprints,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mixing": op10_source_mixing,
}

ORACLES: dict[str, str] = {
    "op3_url_filter": OP3_SQL,
    "op10_source_mixing": OP10_SQL,
}
