"""Queries of the text operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .exact_dedup import OP5_SQL, op5_bloom_exact_dedup
from .licenses import op6_license_notices
from .line_dedup import OP2_SQL, op2_line_templates
from .packing import op7_certified_packing
from .quality import op9_quality_neighbours
from .simhash import op4_simhash_bytes
from .topk import OP10_SQL, op10_pivot_topk
from .toxicity import op1_toxicity_segments
from .wordpiece import op3_wordpiece_counts

QUERIES = {
    "op1_toxicity_segments": op1_toxicity_segments,
    "op2_line_templates": op2_line_templates,
    "op3_wordpiece_counts": op3_wordpiece_counts,
    "op4_simhash_bytes": op4_simhash_bytes,
    "op5_bloom_exact_dedup": op5_bloom_exact_dedup,
    "op6_license_notices": op6_license_notices,
    "op7_certified_packing": op7_certified_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_neighbours": op9_quality_neighbours,
    "op10_pivot_topk": op10_pivot_topk,
}

ORACLE: dict[str, str] = {"op2_line_templates": OP2_SQL, "op5_bloom_exact_dedup": OP5_SQL, "op10_pivot_topk": OP10_SQL}
