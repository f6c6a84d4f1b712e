"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import chat, filter_audit, idstore, katz, licenses, media, quality, ring, runs, sentencepiece_viterbi, simhash, token_counts, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op4_preference_formatting": chat.op4_preference_formatting,
    "op5_license_scan": licenses.op5_license_scan,
    "op1_avi_motion_jpeg": media.op1_avi_motion_jpeg,
    "op2_sentencepiece_codec": sentencepiece_viterbi.op2_sentencepiece_codec,
    "op10_token_counts": token_counts.op10_token_counts,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op3_hash_ring_shards": ring.op3_hash_ring_shards,
    "op9_token_id_store": idstore.op9_token_id_store,
    "op6_benchmark_decontamination": winnow.op6_benchmark_decontamination,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op11_katz_lm_scores": katz.op11_katz_lm_scores,
    "op13_periodic_runs": runs.op13_periodic_runs,
    "op12_filter_interaction_audit": filter_audit.op12_filter_interaction_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op4_preference_formatting": chat.ORACLE_SQL,
    "op6_benchmark_decontamination": winnow.ORACLE_SQL,
    "op12_filter_interaction_audit": filter_audit.ORACLE_SQL,
}
