"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from . import chat, decontaminate, langid, lm, packing, quality, secrets, simhash, toxicity, urlfilter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_language_id": langid.op8_language_id,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_lm_scoring": lm.op10_lm_scoring,
}

ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
}
