"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from ionframe.llm import divergence, embedding_dedup, exact_dedup, fingerprints, langid, line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language_id": langid.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_warc": warc.op10_warc,
    "op11_divergence_audit": divergence.op11_divergence_audit,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_ngram_join": ngram_join.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_divergence_audit": divergence.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
