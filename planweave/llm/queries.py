"""All registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from planweave.llm import align, chat, hamming, mixing, near_dup, packing, pii, quality, repair, repeats, secret_scan, token_file, toxicity

_MODULES = (token_file, quality, near_dup, toxicity, mixing, pii, hamming, repeats, packing, chat, secret_scan, align, repair)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
