"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, language_model, license_scan, packing, quality_classifier, quality_rules, sharding, simhash, toxicity

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_simhash": simhash.query,
    "op4_license_scan": license_scan.query,
    "op5_sharding": sharding.query,
    "op6_toxicity": toxicity.query,
    "op7_language_model": language_model.query,
    "op8_quality_rules": quality_rules.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_packing": packing.query,
}
SQL = {
    "op4_license_scan": license_scan.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
}
