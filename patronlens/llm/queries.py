"""The registered queries of this folder and the SQL they are compared with."""

from __future__ import annotations

import corpus_pipeline
from patronlens.llm import (
    centroids,
    chat,
    embedding_dedup,
    hidden_markov,
    infill,
    jaccard_join,
    mixing,
    packing,
    substring_dedup,
    token_files,
    topk,
    toxicity,
    warc,
)


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1,
        "op2_jaccard_join": jaccard_join.op2,
        "op3_chat_format": chat.op3,
        "op4_toxicity": toxicity.op4,
        "op5_token_files": token_files.op5,
        "op6_best_fit_packing": packing.op6,
        "op7_substring_dedup": substring_dedup.op7,
        "op8_mixing": mixing.op8,
        "op9_warc": warc.op9,
        "op10_top_k": topk.op10,
        "op11_fill_in_middle": infill.op11,
        "op12_centroids": centroids.op12,
        "op13_hidden_markov": hidden_markov.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.ORACLE,
        "op3_chat_format": chat.ORACLE,
        "op10_top_k": topk.ORACLE,
        "op11_fill_in_middle": infill.ORACLE,
        "op12_centroids": centroids.ORACLE,
    }
