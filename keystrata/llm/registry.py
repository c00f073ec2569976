"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from keystrata.llm import fuzzy_lines, minhash, mixing, quality, rank_bpe, substrings, syncmers, token_counts, topk, url_rules

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_mix": mixing.op3_mix,
    "op4_substrings": substrings.op4_substrings,
    "op5_minhash": minhash.op5_minhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_fuzzy_lines": fuzzy_lines.op7_fuzzy_lines,
    "op8_rank_bpe": rank_bpe.op8_rank_bpe,
    "op9_syncmers": syncmers.op9_syncmers,
    "op10_top_k": topk.op10_top_k,
}

SQL = {
    "op2_url_rules": url_rules.OP2_SQL,
    "op3_mix": mixing.OP3_SQL,
    "op4_substrings": substrings.OP4_SQL,
    "op5_minhash": minhash.OP5_SQL,
    "op10_top_k": topk.OP10_SQL,
}
