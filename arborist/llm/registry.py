"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, divergence, jaccard, langid, lmscore, mixing, neardup, quality, sharding, substring, topk, whitening


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_substring": substring.op2_substring,
        "op3_lmscore": lmscore.op3_lmscore,
        "op4_chat": chat.op4_chat,
        "op5_langid": langid.op5_langid,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_neardup": neardup.op7_neardup,
        "op8_quality": quality.op8_quality,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
        "op11_jaccard": jaccard.op11_jaccard,
        "op12_whitening": whitening.op12_whitening,
        "op13_divergence": divergence.op13_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.ORACLE,
        "op4_chat": chat.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op10_sharding": sharding.ORACLE,
        "op13_divergence": divergence.ORACLE,
    }
