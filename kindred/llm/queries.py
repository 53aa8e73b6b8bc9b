"""Queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op9_nearest_neighbours
from .fingerprints import op2_fingerprints
from .html_extract import op6_html_extract
from .minhash_dedup import op4_minhash_dedup
from .packing import op3_packing
from .pieces import op7_pieces
from .quality import op8_quality_classifier
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .url_filters import OP10_SQL, op10_url_filters

QUERIES = {q.__name__: q for q in (op1_substring_dedup, op2_fingerprints, op3_packing, op4_minhash_dedup, op5_suffix_dedup, op6_html_extract, op7_pieces, op8_quality_classifier, op9_nearest_neighbours, op10_url_filters)}

ORACLE_SQL: dict[str, str] = {"op10_url_filters": OP10_SQL}
