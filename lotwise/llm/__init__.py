"""Operations of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

``QUERIES`` and ``ORACLE`` hold the registered queries of this subpackage and,
where SQL can express them, the DuckDB SQL of the same rows.  Nothing else in the
library imports this subpackage.
"""

from __future__ import annotations

from lotwise.llm import (
    bpe_codec, conversation_repair, embed_dedup, exact_dedup, hard_negatives, html_sst, mixing, ngram_join, pii, token_counts,
    toxicity, url_cascade, warc)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_curriculum_mix": mixing.op2_curriculum_mix,
    "op3_content_sort": exact_dedup.op3_content_sort,
    "op4_style_tree": html_sst.op4_style_tree,
    "op5_pca_tiles": embed_dedup.op5_pca_tiles,
    "op6_forced_bpe": bpe_codec.op6_forced_bpe,
    "op7_subword_toxicity": toxicity.op7_subword_toxicity,
    "op8_warc_zstd": warc.op8_warc_zstd,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_url_cascade": url_cascade.op13_url_cascade,
}

ORACLE = {
    "op2_curriculum_mix": mixing.OP2_SQL,
    "op3_content_sort": exact_dedup.OP3_SQL,
    "op8_warc_zstd": warc.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_url_cascade": url_cascade.OP13_SQL,
}
