"""Query op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .lsh import near_duplicates


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"), 0.93)
