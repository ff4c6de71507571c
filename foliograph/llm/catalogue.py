"""Registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from foliograph.llm import chat, decontamination, html, media, packing, passages, sharding, simhash, suffixes, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_passages": passages.op3_passages,
    "op4_chat": chat.op4_chat,
    "op5_html": html.op5_html,
    "op6_media": media.op6_media,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLES: dict[str, str] = {
    "op4_chat": chat.ORACLE,
    "op9_suffixes": suffixes.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
}
