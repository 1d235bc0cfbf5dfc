"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from factorspark.llm import ann, bpe, conversation_trie, decontaminate, html_crf, language, pii, quality, simhash, suffix_dedup, token_counts, urls, vector_codes

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_url_filter": urls.op2_url_filter,
    "op3_html": html_crf.op3_html,
    "op4_pii": pii.op4_pii,
    "op5_quality": quality.op5_quality,
    "op6_ann": ann.op6_ann,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_bpe": bpe.op8_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_language": language.op10_language,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_url_filter": urls.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
