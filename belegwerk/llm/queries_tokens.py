"""Queries op3 and op6: tokens of every whole document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_documents
from .common import table, written
from .lengths import context_answers, length_histogram

RANKS = "byte_bpe_50k.tiktoken"


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = encode_documents(table(spark, folder, "documents"), path, pattern)
    decoded = decode_ids(encoded, path, pattern)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by encoded length; every occurring length is a row and answers for that context limit."""
    encoded = encode_documents(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    # Read more than once below, and every reading would encode all texts again.
    return context_answers(written(length_histogram(encoded.select(F.size("ids").alias("length"))), "histogram"))
