"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from calorix.llm import bpe, cover, golomb_dedup, importance, langid, lexical, mixing, packing, pii, pitman_yor, quality, secrets, simhash

QUERIES = {
    "op1_cover_tree_near_vectors": cover.query,
    "op2_secret_scan": secrets.query,
    "op3_language_id": langid.query,
    "op4_ordinal_quality": quality.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_golomb_exact_dedup": golomb_dedup.query,
    "op8_mix_sources": mixing.query,
    "op7_pitman_yor_lm": pitman_yor.query,
    "op9_pii_weak_supervision": pii.query,
    "op10_bpe_encode_decode": bpe.query,
    "op11_importance_resampling": importance.query,
    "op12_harmonic_packing": packing.query,
    "op13_block_max_search": lexical.query,
}
ORACLES = {
    "op1_cover_tree_near_vectors": cover.ORACLE,
    "op6_golomb_exact_dedup": golomb_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op13_block_max_search": lexical.ORACLE,
}
