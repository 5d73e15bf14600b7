"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from spindle.llm import alignment, bpe, collocations, decontaminate, html_text, jaccard, langid, licenses, quality, substring_dedup, token_count, toxicity, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_bpe": bpe.op2_bpe,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_language_id": langid.op5_language_id,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_alignment": alignment.op11_alignment,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_html_extraction": html_text.op13_html_extraction,
}

SQL: dict[str, str] = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_quality": quality.OP4_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
}
