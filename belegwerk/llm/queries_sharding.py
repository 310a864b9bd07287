"""Query op2: every document in a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import shard_documents


def op2_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    out = shard_documents(table(spark, folder, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
