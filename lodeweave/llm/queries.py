"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import html_text, language_model, media, mixing, packing, quality_rules, secrets, sharding, simhash, toxicity

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secrets": secrets.op3_secrets,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_language_model": language_model.op8_language_model,
    "op9_simhash": simhash.op9_simhash,
    "op10_media": media.op10_media,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
}
