"""Queries of the subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from massloom.llm.op10_token_counts import op10_token_counts
from massloom.llm.op11_conversation_repair import ORACLE_SQL as REPAIR_SQL
from massloom.llm.op11_conversation_repair import op11_conversation_repair
from massloom.llm.op12_fill_in_middle import ORACLE_SQL as FILL_IN_MIDDLE_SQL
from massloom.llm.op12_fill_in_middle import op12_fill_in_middle
from massloom.llm.op13_language_id import op13_language_id
from massloom.llm.op1_packing import op1_packing
from massloom.llm.op2_kmeans_tree import op2_kmeans_tree
from massloom.llm.op3_quality_rules import op3_quality_rules
from massloom.llm.op4_rule_ensemble import op4_rule_ensemble
from massloom.llm.op5_secrets import op5_secrets
from massloom.llm.op6_jaccard_join import op6_jaccard_join
from massloom.llm.op7_sharding import op7_sharding
from massloom.llm.op8_mixing import ORACLE_SQL as MIXING_SQL
from massloom.llm.op8_mixing import op8_mixing
from massloom.llm.op9_lm_scoring import op9_lm_scoring

QUERIES = {
    "op1_packing": op1_packing,
    "op2_kmeans_tree": op2_kmeans_tree,
    "op3_quality_rules": op3_quality_rules,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_secrets": op5_secrets,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}

ORACLES = {"op8_mixing": MIXING_SQL, "op11_conversation_repair": REPAIR_SQL, "op12_fill_in_middle": FILL_IN_MIDDLE_SQL}
