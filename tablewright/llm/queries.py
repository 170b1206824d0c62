"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from tablewright.llm.bpe import op6_byte_bpe
from tablewright.llm.divergence import OP12_SQL, op12_source_divergence
from tablewright.llm.fill_middle import OP13_SQL, op13_fill_in_middle
from tablewright.llm.mixing import OP9_SQL, op9_mix_sources
from tablewright.llm.near_dedup import OP2_SQL, op2_minhash_near_dedup
from tablewright.llm.quality_classifier import op4_ordinal_quality
from tablewright.llm.quality_rules import op5_robust_quality_rules
from tablewright.llm.suffix_dedup import op11_suffix_array_dedup
from tablewright.llm.tool_calls import OP7_SQL, op7_tool_call_linking
from tablewright.llm.topk_search import OP3_SQL, op3_pivot_top_k
from tablewright.llm.toxicity import op8_crf_toxicity
from tablewright.llm.url_lists import OP10_SQL, op10_temporal_url_filter
from tablewright.llm.warc import OP1_SQL, op1_warc_revisits

QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_minhash_near_dedup, op3_pivot_top_k, op4_ordinal_quality, op5_robust_quality_rules, op6_byte_bpe, op7_tool_call_linking, op8_crf_toxicity, op9_mix_sources, op10_temporal_url_filter, op11_suffix_array_dedup, op12_source_divergence, op13_fill_in_middle)}
ORACLE_SQL = {"op1_warc_revisits": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op3_pivot_top_k": OP3_SQL, "op7_tool_call_linking": OP7_SQL, "op9_mix_sources": OP9_SQL, "op10_temporal_url_filter": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
