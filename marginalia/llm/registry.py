"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marginalia.llm import forced_bpe, language_id, lexical_search, media, merge_replay, near_dedup, packing, quality, secrets, substring_dedup, token_alignment, token_store, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": media.op1_media,
        "op2_language_id": language_id.op2_language_id,
        "op3_forced_bpe": forced_bpe.op3_forced_bpe,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_secrets": secrets.op5_secrets,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_packing": packing.op7_packing,
        "op8_token_store": token_store.op8_token_store,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_quality": quality.op10_quality,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_merge_replay": merge_replay.op12_merge_replay,
        "op13_token_alignment": token_alignment.op13_token_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL, or too slow in it on whole tables; tests/llm hold them against brute force."""
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op4_substring_dedup": substring_dedup.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL, **pipeline}
