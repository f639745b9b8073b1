"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import fmindex, licenses, media, mixing, neardup, pieces, quality, resample, secrets, spots, suffixes, toxicity, whitening


def queries() -> dict:
    return {"op1_licenses": licenses.op1_licenses, "op2_quality": quality.op2_quality, "op3_media": media.op3_media, "op4_pieces": pieces.op4_pieces, "op5_fingerprints": spots.op5_fingerprints, "op6_mixing": mixing.op6_mixing, "op7_fmindex": fmindex.op7_fmindex, "op8_secrets": secrets.op8_secrets, "op8_secrets_wide": secrets.op8_secrets_wide, "op9_neardup": neardup.op9_neardup, "op10_suffixes": suffixes.op10_suffixes, "op11_resample": resample.op11_resample, "op12_toxicity": toxicity.op12_toxicity, "op13_whitening": whitening.op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.OP1_SQL, "op6_mixing": mixing.OP6_SQL, "op7_fmindex": fmindex.OP7_SQL, "op8_secrets": secrets.OP8_SQL, "op8_secrets_wide": secrets.OP8_WIDE_SQL, "op9_neardup": neardup.OP9_SQL, "op10_suffixes": suffixes.OP10_SQL, "op11_resample": resample.OP11_SQL}
