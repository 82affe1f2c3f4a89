"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import interactions, jaccard, rules, url_filter
from .chunks import op1_gear_chunks
from .dac import op2_dac_tokens
from .hilbert import op3_hilbert_shards
from .interactions import op11_filter_interactions
from .jaccard import op9_count_vector_rtree
from .kdtree import op12_kdtree_clusters
from .mixing import op7_hash_threshold_mix
from .rules import op5_rule_ledger
from .secrets import op8_secret_scan
from .suffixes import op13_suffix_dedup
from .syncmers import op6_closed_syncmers
from .tree_bpe import op4_tree_bpe
from .url_filter import op10_temporal_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gear_chunks, op2_dac_tokens, op3_hilbert_shards, op4_tree_bpe, op5_rule_ledger, op6_closed_syncmers, op7_hash_threshold_mix, op8_secret_scan, op9_count_vector_rtree, op10_temporal_url_filter, op11_filter_interactions, op12_kdtree_clusters, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_rule_ledger": rules.ORACLE, "op9_count_vector_rtree": jaccard.ORACLE, "op10_temporal_url_filter": url_filter.ORACLE, "op11_filter_interactions": interactions.ORACLE}
