"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .conversation_repair import OP11_SQL, op11_conversation_repair
from .decontaminate import op1_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .html_extract import op7_html_extract
from .importance import OP12_SQL, op12_importance
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .language import op2_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import LLM_MIX_TARGETS_SQL, llm_mix_targets, op3_mixing
from .quality import op10_quality
from .sharding import op5_sharding
from .suffix_dedup import OP13_SQL, op13_suffix_dedup
from .url_filter import LLM_URL_RULES_SQL, llm_url_rules, op8_url_filter

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_mixing, op4_line_dedup, op5_sharding, op6_jaccard_join, op7_html_extract, op8_url_filter, op9_exact_dedup, op10_quality, op11_conversation_repair, op12_importance, op13_suffix_dedup, llm_mix_targets, llm_url_rules)}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_importance": OP12_SQL, "op13_suffix_dedup": OP13_SQL, "llm_mix_targets": LLM_MIX_TARGETS_SQL, "llm_url_rules": LLM_URL_RULES_SQL}
