"""The registered queries of this subpackage."""

from __future__ import annotations

from curbspark.llm import (
    bpe,
    chat,
    exact_dedup,
    hard_negatives,
    html_text,
    jaccard_join,
    language,
    mixing,
    pii,
    quality,
    secrets,
    spelling,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii": pii.op3_pii,
    "op4_bpe": bpe.op4_bpe,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_language_id": language.op12_language_id,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
