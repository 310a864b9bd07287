"""Query op5: every page's url judged by rules, then by the trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urls import JUDGEMENT, UrlRule, judge

RULES = [UrlRule("com/", "allow"), UrlRule("example.com/en/", "block"), UrlRule("www.example.com/en/", "allow"),
         UrlRule("net/es/", "block"), UrlRule("net/fr/", "block")]


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), RULES).select("page_id", "host", "path", "rule", JUDGEMENT, "blocked_score")
