"""Query op10: every document with the chance of being good, by text, by metadata and by both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import classify


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "keep")
