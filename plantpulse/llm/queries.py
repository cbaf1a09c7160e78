"""Queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from plantpulse.llm import (
    alignment, byte_bpe, exact_dedup, fuzzy_hash, html_text, jaccard_join, language, lexical_search, mixing, quality,
    sharding, toxicity, vector_dedup)

QUERIES = {
    "op1_language": language.query,
    "op2_quality": quality.query,
    "op3_fuzzy_hash": fuzzy_hash.query,
    "op4_mixing": mixing.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_toxicity": toxicity.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_html_text": html_text.query,
    "op9_sharding": sharding.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_vector_dedup": vector_dedup.query,
    "op12_lexical_search": lexical_search.query,
    "op13_alignment": alignment.query,
}

SQL = {
    "op5_jaccard_join": jaccard_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_vector_dedup": vector_dedup.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
