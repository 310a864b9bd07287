"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    queries_contamination, queries_conversations, queries_jaccard, queries_lsh, queries_negatives, queries_quality, queries_secrets,
    queries_sharding, queries_suffixes, queries_tokens, queries_toxicity, queries_urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        queries_secrets.op1_secret_scan, queries_sharding.op2_hash_tree, queries_tokens.op3_byte_bpe,
        queries_suffixes.op4_suffix_dedup, queries_urls.op5_url_filter,
        queries_tokens.op6_token_counts, queries_jaccard.op7_jaccard_join, queries_lsh.op8_embedding_dedup,
        queries_contamination.op9_contamination, queries_quality.op10_quality,
        queries_toxicity.op11_toxicity, queries_conversations.op12_conversation_repair,
        queries_negatives.op13_hard_negatives)}
SQL: dict[str, str] = {"op1_secret_scan": queries_secrets.SQL, "op7_jaccard_join": queries_jaccard.SQL,
                       "op9_contamination": queries_contamination.SQL, "op12_conversation_repair": queries_conversations.SQL,
                       "op13_hard_negatives": queries_negatives.SQL}
