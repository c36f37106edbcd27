"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, embeddings, minhash, mixing, quality, substrings, suffixes, tokens, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_chat_format": chat.op3_chat_format,
    "op4_minhash_dedup": minhash.op4_minhash_dedup,
    "op5_quality": quality.op5_quality,
    "op6_token_records": tokens.op6_token_records,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_mix_sources": mixing.SQL,
    "op3_chat_format": chat.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
