"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from tideweave.llm import (
    byte_bpe, centroids, chat_format, decontaminate, embedding_dedup, fill_in_middle, jaccard, mixing, pii, quality, sharding, toxicity, url_filter,
)


def queries() -> dict:
    """name -> callable (spark, sf_dir)."""
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_near_duplicates": embedding_dedup.op2_near_duplicates,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_shard": sharding.op6_shard,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_mix": mixing.op8_mix,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
        "op11_centroids": centroids.op11_centroids,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
        "mix_targets": mixing.mix_targets,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """name -> DuckDB SQL, where SQL can express the query."""
    return {
        "op1_url_filter": url_filter.ORACLE_SQL,
        "op2_near_duplicates": embedding_dedup.ORACLE_SQL,
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op6_shard": sharding.ORACLE_SQL,
        "op7_jaccard": jaccard.ORACLE_SQL,
        "op9_pii": pii.ORACLE_SQL,
        "op11_centroids": centroids.ORACLE_SQL,
        "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "mix_targets": mixing.TARGETS_SQL,
    }
