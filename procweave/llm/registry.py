"""The queries of the corpus operators and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procweave.llm import conversations, decontaminate, fingerprints, language, language_model, licence, near_dedup, pack, resample, shard, substring_dedup, suffix_dedup, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        shard.op1_hypergeometric_sharding,
        pack.op2_best_fit_packing,
        language_model.op3_maxent_lm_scoring,
        suffix_dedup.op4_suffix_array_dedup,
        topk.op5_exact_top_k,
        decontaminate.op6_benchmark_decontamination,
        licence.op7_license_scan,
        substring_dedup.op8_substring_dedup,
        language.op9_language_id,
        near_dedup.op10_minhash_near_dedup,
        resample.op11_importance_resampling,
        conversations.op12_conversation_repair,
        fingerprints.op13_document_fingerprints,
    ]
    return {f.__name__: f for f in functions}


def oracles() -> dict[str, str]:
    return {
        "op5_exact_top_k": topk.SQL,
        "op6_benchmark_decontamination": decontaminate.SQL,
        "op8_substring_dedup": substring_dedup.SQL,
        "op10_minhash_near_dedup": near_dedup.SQL,
        "op11_importance_resampling": resample.SQL,
        "op12_conversation_repair": conversations.SQL,
    }
