"""Queries of this subpackage's operators (the pipeline over them is corpus_pipeline.py), and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op2_template_windows
from .html_text import op9_crf_blocks
from .licenses import op5_rare_word_index
from .lm import op10_backoff_automaton
from .packing import op4_best_fit_decreasing
from .quality import SQL as QUALITY_SQL
from .quality import op3_quality_cascade
from .sharding import op8_stratified_interleave
from .simhash import op6_vantage_point_trees
from .token_files import op7_bit_packed_ids
from .urls import SQL as URL_SQL
from .urls import op1_redirect_equivalence

QUERIES = {
    "op1_redirect_equivalence": op1_redirect_equivalence,
    "op2_template_windows": op2_template_windows,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_best_fit_decreasing": op4_best_fit_decreasing,
    "op5_rare_word_index": op5_rare_word_index,
    "op6_vantage_point_trees": op6_vantage_point_trees,
    "op7_bit_packed_ids": op7_bit_packed_ids,
    "op8_stratified_interleave": op8_stratified_interleave,
    "op9_crf_blocks": op9_crf_blocks,
    "op10_backoff_automaton": op10_backoff_automaton,
}

ORACLE_SQL: dict[str, str] = {"op1_redirect_equivalence": URL_SQL, "op3_quality_cascade": QUALITY_SQL}
