"""The text operators' queries by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import op1_sentencepiece, op2_toxicity, op3_embeddings, op4_language, op5_substring, op6_lines, op7_jaccard, op8_suffix, op9_mixing, op10_exact

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_embedding_dedup": op3_embeddings.query,
    "op4_language_id": op4_language.query,
    "op5_substring_dedup": op5_substring.query,
    "op6_line_dedup": op6_lines.query,
    "op7_ngram_jaccard_join": op7_jaccard.query,
    "op8_suffix_array_dedup": op8_suffix.query,
    "op9_source_mixing": op9_mixing.query,
    "op10_exact_dedup": op10_exact.query,
}

SQL = {
    "op3_embedding_dedup": op3_embeddings.SQL,
    "op5_substring_dedup": op5_substring.SQL,
    "op6_line_dedup": op6_lines.SQL,
    "op7_ngram_jaccard_join": op7_jaccard.SQL,
    "op8_suffix_array_dedup": op8_suffix.SQL,
    "op10_exact_dedup": op10_exact.SQL,
}
