"""All named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_amounts, queries_corpus, queries_model, queries_repair, queries_runs, queries_score, queries_text  # noqa: F401
from .bindings import Tables
from .registry import QUERIES, SQL


def names() -> list[str]:
    return list(QUERIES)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))


def sql() -> dict[str, str]:
    return dict(SQL)
