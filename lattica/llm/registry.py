"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from lattica.llm import chat, decontaminate, exact_dedup, mixing, pii, quality, secrets, simhash, suffix_dedup, tokens

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_chat_format": chat.op2_chat_format,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_personal_data": pii.op4_personal_data,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_simhash": simhash.op7_simhash,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": tokens.op10_token_counts,
}
ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
}
