"""The queries of this package by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .collocations import OP13_SQL, op13_collocations
from .conversation_repair import OP11_SQL, op11_conversation_repair
from .decontaminate import OP9_SQL, op9_decontaminate
from .line_rules import OP12_SQL, op12_quality_rules
from .minhash import op2_near_duplicates
from .mixing import OP6_SQL, op6_mix_sources
from .piecewise_hash import op10_fingerprints
from .quality import op8_quality
from .secret_scan import op4_secrets
from .sharding import op7_shards
from .token_shards import op3_token_shards
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_shards": op3_token_shards,
    "op4_secrets": op4_secrets,
    "op5_chat_format": op5_chat_format,
    "op6_mix_sources": op6_mix_sources,
    "op7_shards": op7_shards,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op5_chat_format": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
