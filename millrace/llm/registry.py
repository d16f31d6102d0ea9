"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import chat, codes, decontamination, jaccard, language, mixing, neighbours, pii, secrets, tokens, topk, trie, urls

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_language_id": language.op3_language_id,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_pii_surrogates": pii.op7_pii_surrogates,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_chat_format": chat.op10_chat_format,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {
    "op1_url_filter": urls.sql(),
    "op2_source_mix": mixing.sql(),
    "op9_decontamination": decontamination.SQL,
    "op11_conversation_trie": trie.SQL,
    "op12_exact_topk": topk.SQL,
    "op13_vector_codes": codes.sql(),
}
