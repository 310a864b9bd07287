"""Query op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import score, train


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, train(docs, table(spark, folder, "labels")))
