"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from captionforge.llm import byte_bpe, fingerprints, hmm, jaccard, lexical, lines, packing, prefix_trie, quality, secrets, sql, substrings, topk, url_lists

MODULES = (packing, url_lists, fingerprints, lines, quality, byte_bpe, substrings, hmm, secrets, jaccard, prefix_trie, lexical, topk)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()} | sql.ORACLES
