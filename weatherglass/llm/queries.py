"""The queries of this subpackage, by name, and the SQL that some of them can be checked against."""

from __future__ import annotations

from . import chat, decontamination, exact_dedup, hard_negatives, licenses, mtree, periodic_runs, quality, sentencepiece_codec, sharding, simhash, token_counts, wrappers


def queries() -> dict:
    return {
        "op1_license_scans": licenses.query,
        "op2_html_extraction": wrappers.query,
        "op3_token_counts": token_counts.query,
        "op4_exact_top_k": mtree.query,
        "op5_chat_formatting": chat.query,
        "op6_quality_classifier": quality.query,
        "op7_decontamination": decontamination.query,
        "op8_sharding": sharding.query,
        "op9_simhash_dedup": simhash.query,
        "op10_sentencepiece": sentencepiece_codec.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": mtree.ORACLE, "op5_chat_formatting": chat.ORACLE, "op11_exact_dedup": exact_dedup.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
