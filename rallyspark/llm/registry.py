"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat_format, conversation_trie, exact_dedup, hard_negatives, html_extract, mixing, packing, pii, quality, simhash, token_io, url_filter, warc


def queries() -> dict:
    return {
        "op1_warc_zip": warc.op1,
        "op2_exact_dedup": exact_dedup.op2,
        "op3_packing": packing.op3,
        "op4_simhash": simhash.op4,
        "op5_quality_rules": quality.op5,
        "op6_token_ids": token_io.op6,
        "op7_personal_data": pii.op7,
        "op8_url_filter": url_filter.op8,
        "op9_mixing": mixing.op9,
        "op10_html_text": html_extract.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_chat_format": chat_format.op12,
        "op13_prefix_trie": conversation_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_zip": warc.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op5_quality_rules": quality.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_chat_format": chat_format.SQL,
        "op13_prefix_trie": conversation_trie.SQL,
    }
