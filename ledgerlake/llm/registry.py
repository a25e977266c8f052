"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from ledgerlake.llm import chat_format, fill_middle, learned_index, line_dedup, near_dedup, packing, personal_data, quality_classifier, quality_rules, sentence_pieces, sorted_tables, spelling_variants, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_best_fit_packing": packing.query,
    "op3_url_filter": url_filter.query,
    "op4_line_dedup": line_dedup.query,
    "op5_sentencepiece": sentence_pieces.query,
    "op6_near_dedup": near_dedup.query,
    "op7_learned_index": learned_index.query,
    "op8_chat_format": chat_format.query,
    "op9_token_output": sorted_tables.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_fill_middle": fill_middle.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_personal_data": personal_data.query,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_url_filter": url_filter.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
}
