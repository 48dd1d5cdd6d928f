"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op11_byte_bpe
from .chat import OP3_SQL, op3_prefix_target_chat
from .clustering import OP13_SQL, op13_block_norm_clusters
from .exact_dedup import OP4_SQL, op4_grace_dedup
from .html_extract import op6_boosted_dom
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP9_SQL, op9_sainte_lague_mix
from .packing import op1_best_fit_packing
from .quality import op5_bradley_terry
from .rules import op7_decision_list
from .sharding import op2_external_shuffle
from .simhash import op8_simhash
from .toxicity import op10_levenshtein_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_external_shuffle, op3_prefix_target_chat, op4_grace_dedup, op5_bradley_terry,
        op6_boosted_dom, op7_decision_list, op8_simhash, op9_sainte_lague_mix, op10_levenshtein_toxicity,
        op11_byte_bpe, op12_merkle_manifest, op13_block_norm_clusters,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_prefix_target_chat": OP3_SQL, "op4_grace_dedup": OP4_SQL, "op9_sainte_lague_mix": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_block_norm_clusters": OP13_SQL}
