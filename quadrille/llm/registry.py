"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quadrille.llm import chat, decontaminate, exact_dedup, language_id, licences, pii, resample, secrets, sentencepieces, simhash, trie, warc, whiten

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pii": pii.op5_pii,
    "op6_quality_resample": resample.op6_quality_resample,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_sentencepiece": sentencepieces.op9_sentencepiece,
    "op10_license_scan": licences.op10_license_scan,
    "op11_warc": warc.op11_warc,
    "op12_whiten": whiten.op12_whiten,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_license_scan": licences.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_conversation_trie": trie.OP13_SQL,
}
