"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lakeloom.llm import bpe, decontamination, exact_dedup, katz, language_id, partial, personal_data, pieces, quality, secret_scan, simhash, simhash_sql, token_cuts, toxicity, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_personal_data": personal_data.op4_personal_data,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_katz": katz.op8_katz,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_quality": quality.op10_quality,
    "op11_pieces": pieces.op11_pieces,
    "op12_token_cuts": token_cuts.op12_token_cuts,
    "op13_whitening": whitening.op13_whitening,
    **partial.QUERIES,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_simhash": simhash_sql.OP3_SQL,
    **partial.ORACLES,
}
