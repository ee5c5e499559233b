"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, exact_dedup, fill_in_middle, mixing, near_dedup, pii, sentence_pieces, sharding, source_divergence, token_counts, toxicity, vector_search, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_pii": pii.op2_pii,
    "op3_sharding": sharding.op3_sharding,
    "op4_vector_search": vector_search.op4_vector_search,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_sentence_pieces": sentence_pieces.op7_sentence_pieces,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op5_warc": warc.OP5_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_chat_format": chat_format.OP11_SQL,
    "op12_source_divergence": source_divergence.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
