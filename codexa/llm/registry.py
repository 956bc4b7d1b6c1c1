"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from codexa.llm import audio, decontaminate, langid, line_dedup, near_dedup, packing, pii, quality_lm, token_prefix, url_lists

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_url_filters": url_lists.query,
    "op4_language_id": langid.query,
    "op5_pii": pii.query,
    "op6_line_dedup": line_dedup.query,
    "op6_line_dedup_all_lengths": line_dedup.query_all_lengths,
    "op7_media_audio_features": audio.query,
    "op8_best_fit_packing": packing.query,
    "op9_quality_classifier": quality_lm.query,
    "op10_token_counts": token_prefix.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": url_lists.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op6_line_dedup_all_lengths": line_dedup.SQL_ALL_LENGTHS,
}
