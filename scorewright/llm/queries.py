"""The queries of this package: name -> callable of (spark, sf_dir), and SQL for those that SQL can express."""

from scorewright.llm import byte_bpe, exact_dedup, language, lm_scoring, near_dedup, packing, phrases, piece_bpe, prefix_trie, quality, sharding, token_output, vector_search

QUERIES = {
    "op1_near_dedup": near_dedup.op1,
    "op2_vector_search": vector_search.op2,
    "op3_quality": quality.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_token_output": token_output.op5,
    "op6_language": language.op6,
    "op7_packing": packing.op7,
    "op8_lm_scoring": lm_scoring.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_sharding": sharding.op10,
    "op11_piece_bpe": piece_bpe.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_phrases": phrases.op13,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_vector_search": vector_search.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
