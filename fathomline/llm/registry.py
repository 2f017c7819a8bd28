"""Registered queries of the corpus operators."""

from __future__ import annotations

from fathomline.llm import q_bpe, q_chat, q_decontaminate, q_html, q_lexical, q_lm, q_near_dups, q_packing, q_quality, q_rules, q_secrets, q_shards, q_tries

MODULES = (q_decontaminate, q_rules, q_shards, q_lm, q_near_dups, q_quality, q_html, q_secrets, q_bpe, q_chat, q_packing, q_tries, q_lexical)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
