"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treesync.llm import bpe, decontaminate, embed_dedup, exact_dedup, filter_audit, jaccard_join, langid, packing, pii, quality, shuffle, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_sharding": shuffle.op3_sharding,
        "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
        "op5_language": langid.op5_language,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_bpe": bpe.op7_bpe,
        "op8_pii": pii.op8_pii,
        "op9_packing": packing.op9_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_decontamination": decontaminate.op12_decontamination,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op4_embedding_dedup": embed_dedup.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_decontamination": decontaminate.SQL,
        "op13_vector_codes": vector_codes.sql(),
    }
