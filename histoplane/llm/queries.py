"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, fingerprints, html_text, licenses, mixing, ngram_join, quality, sentencepiece_bpe, vector_search, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_sentencepiece": sentencepiece_bpe.op3_sentencepiece,
    "op4_html_text": html_text.op4_html_text,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_warc": warc.op6_warc,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_exact_top_k": vector_search.op8_exact_top_k,
    "op9_quality": quality.op9_quality,
    "op10_chat_format": chat.op10_chat_format,
}

ORACLE_SQL = {
    "op2_ngram_jaccard_join": ngram_join.OP2_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_exact_top_k": vector_search.OP8_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
