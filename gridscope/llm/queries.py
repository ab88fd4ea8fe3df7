"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from gridscope.llm import (
    centroids, language, lines, merkle, minhash, mixing, packing, private, quality, substrings, tokens, topk, urls,
)

QUERIES = {
    "op11_centroids": centroids.op11_centroids,
    "op12_url_filters": urls.op12_url_filters,
    "op13_merkle": merkle.op13_merkle,
    "op10_near_duplicates": minhash.op10_near_duplicates,
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_private_data": private.op4_private_data,
    "op5_packing": packing.op5_packing,
    "op6_language": language.op6_language,
    "op7_top_k": topk.op7_top_k,
    "op8_mixing": mixing.op8_mixing,
    "op9_substrings": substrings.op9_substrings,
}
ORACLES = {
    "op11_centroids": centroids.OP11_SQL,
    "op12_url_filters": urls.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
    "op10_near_duplicates": minhash.OP10_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op7_top_k": topk.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
