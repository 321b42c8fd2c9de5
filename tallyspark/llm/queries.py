"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from . import asof, chat, decontamination, fingerprints, language_id, lexical_search, near_dedup, quality, sentencepiece_codec, sharding, substring_dedup, token_counts, toxicity
from .oracles import ORACLES


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
        "op7_sharding": sharding.op7_sharding,
        "op8_chat": chat.op8_chat,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_quality": quality.op10_quality,
        "op11_language_id": language_id.op11_language_id,
        "op12_asof_join": asof.op12_asof_join,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
