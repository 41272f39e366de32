"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontam, embdedup, linededup, lm, minhash, mixing, quality, sharding, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_mixing": mixing.op4_mixing,
    "op5_embedding_near_dedup": embdedup.op5_embedding_near_dedup,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op5_embedding_near_dedup": embdedup.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
