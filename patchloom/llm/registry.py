"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import oracles
from .conversation_repair import op11_conversation_repair
from .decontaminate import op1_benchmark_decontamination
from .language_id import op12_byte_network_language
from .language_model import op4_log_bilinear_scores
from .licenses import op7_license_templates
from .mixing import op8_source_mix
from .quality_model import op5_ftrl_quality
from .quality_rules import op3_host_quality_rules
from .sharding import op9_balanced_label_shards
from .simhash import op6_simhash_near_duplicates
from .source_divergence import op13_source_divergence
from .substring_dedup import op10_relative_lz_dedup
from .toxicity import op2_toxicity_chain

_QUERIES = [
    op1_benchmark_decontamination,
    op2_toxicity_chain,
    op3_host_quality_rules,
    op4_log_bilinear_scores,
    op5_ftrl_quality,
    op6_simhash_near_duplicates,
    op7_license_templates,
    op8_source_mix,
    op9_balanced_label_shards,
    op10_relative_lz_dedup,
    op11_conversation_repair,
    op12_byte_network_language,
    op13_source_divergence,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
