"""The registered training-data queries and their DuckDB counterparts."""

from __future__ import annotations

from lodestone.llm import byte_bpe, chat, decontamination, lm_scoring, quality_classifier, quality_rules, secrets, sharding, simhash, url_filters


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_url_filters": url_filters.op2_url_filters,
        "op3_chat_format": chat.op3_chat_format,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_secret_scans": secrets.op9_secret_scans,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    }


def oracles() -> dict[str, str]:
    return {
        "op2_url_filters": url_filters.OP2_SQL,
        "op3_chat_format": chat.OP3_SQL,
        "op5_quality_rules": quality_rules.OP5_SQL,
        "op8_decontamination": decontamination.OP8_SQL,
        "op9_secret_scans": secrets.OP9_SQL,
    }
