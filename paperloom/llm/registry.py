"""The registered queries of this subpackage: one per operator, over its whole table."""
from __future__ import annotations

from paperloom.llm import align, bpe, fingerprint, langid, lm, neardup, packing, pieces, pii, quality, resample, rollup, substring

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_simhash_neardup": neardup.query,
    "op3_language_id": langid.query,
    "op4_token_rollup": rollup.query,
    "op5_pii": pii.query,
    "op6_lm_score": lm.query,
    "op7_fingerprints": fingerprint.query,
    "op8_substring_dedup": substring.query,
    "op9_best_fit_packing": packing.query,
    "op10_sentencepiece": pieces.query,
    "op11_byte_bpe": bpe.query,
    "op12_resample": resample.query,
    "op13_align": align.query,
}
ORACLES = {"op1_quality_rules": quality.ORACLE, "op8_substring_dedup": substring.ORACLE, "op12_resample": resample.ORACLE}
