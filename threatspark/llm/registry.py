"""Queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import ann, ballkmeans, bpe, chat, jaccard, langid, lm, neardup, negatives, packing, repeats, shards, warc

QUERIES = {
    "op1_multi_index_hashing": ann.query,
    "op2_byte_bpe": bpe.query,
    "op3_embedding_neardup": neardup.query,
    "op4_suffix_tree_lm": lm.query,
    "op5_chat_windows": chat.query,
    "op6_language_id": langid.query,
    "op7_warc_normaliser": warc.query,
    "op8_packing": packing.query,
    "op9_suffix_dedup": repeats.query,
    "op10_ngram_jaccard": jaccard.query,
    "op11_hash_tree": shards.query,
    "op12_inverted_multi_index": negatives.query,
    "op13_ball_kmeans": ballkmeans.query,
}

#: The others have no entry: learned codes and trees, tokenizers, files and 64-bit shingle sets have no SQL
#: that runs on whole tables; tests/llm compares each query with a brute-force version.
ORACLE: dict[str, str] = {
    "op11_hash_tree": shards.oracle(),
    "op12_inverted_multi_index": negatives.oracle(),
    "op13_ball_kmeans": ballkmeans.oracle(),
}
